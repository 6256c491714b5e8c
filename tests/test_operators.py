import itertools
import random
from datetime import date, datetime

from pyspark.sql import functions as F

from vitrine.operators import changes, quality, resolution, tables
from vitrine.operators.total_order import ranked
from vitrine.plans.listing_query import ListingQuery


def test_change_log_compares_with_the_emitted_value(spark):
    rows = [("a", i, v) for i, v in enumerate([1.0, 1.006, 1.012, 1.012, None, 3.0])] + [("b", 0, 0.0), ("b", 1, 2.0)]
    log = changes.change_log(spark.createDataFrame(rows, "k string, i int, v double"), key=["k"], order=["i"], value="v")
    got = sorted((r["k"], r["i"], r["kind"], r["before"], r["delta"], r["delta_pct"]) for r in log.collect())
    assert got == [("a", 0, "CRIADO", None, None, None), ("a", 2, "PRECO_ALTERADO", 1.0, 0.01, 1.2), ("a", 5, "PRECO_ALTERADO", 1.012, 1.99, 196.44), ("b", 0, "CRIADO", None, None, None), ("b", 1, "PRECO_ALTERADO", 0.0, None, None)]


def test_idempotent_log(spark):
    one = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0)], "k string, i int, v double")
    assert changes.change_log(one, key=["k"], order=["i"], value="v").count() == 1


def test_series_drop_and_trend(spark):
    rows = spark.createDataFrame([("a", date(2026, 8, 1), 2500.0), ("a", date(2026, 8, 20), 2000.0), ("b", date(2026, 8, 1), 1.0)], "k string, d date, v double")
    points = changes.last_points(rows, key=["k"], day="d", value="v")
    shown = spark.createDataFrame([("a", 2000.0), ("b", 1.0)], "k string, p double")
    got = {r["k"]: (r["drop"], r["drop_pct"]) for r in changes.drops(points, shown, key=["k"], value="v", price="p").collect()}
    assert got == {"a": (500.0, 20), "b": (None, None)}
    assert changes.trend(points, key=["k"], day="d", value="v").count() == 0


def test_absences(spark):
    seen = spark.createDataFrame([("u1", "s", 1), ("u2", "s", 3), ("u3", "t", 1)], "k string, s string, r bigint")
    runs = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3), ("t", 1), ("t", 2)], "s string, r bigint")
    got = lambda trusted: {r["k"]: (r["absent"], r["status"] == "INATIVO") for r in changes.absences(seen, runs, key="k", source="s", run="r", trusted=trusted).collect()}
    assert got(None) == {"u1": (2, True), "u2": (0, False), "u3": (1, False)}
    assert got(runs.limit(0)) == {"u1": (0, False), "u2": (0, False), "u3": (0, False)}


def test_retention_keeps_unknown_dates(spark):
    rows = spark.createDataFrame([(1, "INATIVO", date(2025, 1, 1)), (2, "INATIVO", date(2026, 5, 1)), (3, "INATIVO", None), (4, "ATIVO", date(2025, 1, 1))], "i int, s string, d date")
    assert sorted(r["i"] for r in changes.pruned(rows, inactive=F.col("s") == "INATIVO", last_seen=F.col("d"), run_date="2026-06-01").collect()) == [2, 3, 4]


def test_sanity(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([30, 30, 30, 2])] + [("b", 0, 5)], "s string, i int, n int")
    got = {(r["s"], r["i"]): r["status"] for r in quality.demoted(quality.recent_median(rows, source="s", at="i", value="n"), value="n").collect()}
    assert got[("a", 3)] == "PARCIAL" and got[("b", 0)] == "OK"


def test_verdict(spark):
    rows = spark.createDataFrame([(1, 2000.0, 3), (2, None, None), (3, 5000.0, 3), (4, 2000.0, 1), (5, 2000.0, None)], "i int, p double, q int")
    v = tables.verdict([tables.Bound("p", F.lit(0), F.lit(2500)), tables.Bound("q", F.lit(2))], [("preco", F.col("p").isNull()), ("quartos", F.col("q").isNull())])
    got = {r["i"]: (r["v"]["verdict"], r["v"]["reasons"]) for r in rows.select("i", v.alias("v")).collect()}
    assert got == {1: ("APROVADO", []), 2: ("INDETERMINADO", ["preco", "quartos"]), 3: ("REPROVADO", []), 4: ("REPROVADO", []), 5: ("INDETERMINADO", ["quartos"])}


LISTING = "url string, site string, bairro string, cidade string, logradouro string, numero string, condominio_nome string, preco double, custo_mensal_total double, quartos int, suites int, banheiros int, vagas int, area_m2 double, latitude double, longitude double, fotos array<string>, descricao string, telefone string, imobiliaria string"


def listing(url, site, street="Rua A", number="10", area=72.0, price=2000.0, rooms=3, city="Recife"):
    return (url, site, "Centro", city, street, number, None, price, price, rooms, None, 2, 1, area, None, None, None, None, None, None)


def test_vetoes_scores_and_clusters(spark):
    rows = spark.createDataFrame([listing("u1", "A"), listing("u2", "B"), listing("u3", "C", street="R. A"), listing("u4", "A"), listing("u5", "D", area=120.0), listing("u6", "E", city="Olinda")], LISTING)
    pairs = resolution.blocked_pairs(rows.select("url", resolution.block_keys().alias("k")), id="url", keys="k")
    scored = resolution.scored_pairs(pairs, rows, id="url")
    by = {(r["a"], r["b"]): r for r in scored.collect()}
    assert by[("u1", "u2")]["class"] == "MESMO_IMOVEL"
    assert by[("u1", "u4")]["veto"] == "mesma_fonte" and by[("u1", "u5")]["veto"] == "area" and by[("u1", "u6")]["veto"] == "cidade"
    groups = {r["id"]: r["cluster"] for r in resolution.clusters(scored, rows, id="url").collect()}
    assert groups["u1"] == groups["u2"] == groups["u3"] == "u1" and groups["u4"] != "u1"
    assert groups["u5"] == "u5" and groups["u6"] == "u6"


def test_clusters_equal_the_sequential_run(spark):
    rnd = random.Random(5)
    data = [listing(f"u{i:02d}", rnd.choice("ABCDEF"), street=rnd.choice(["Rua A", "Rua A B", "Rua B C"]), area=rnd.choice([70.0, 72.0, 75.0]), price=rnd.choice([2000.0, 2050.0, 2200.0])) for i in range(18)]
    rows = spark.createDataFrame(data, LISTING)
    ids = [d[0] for d in data]
    every = spark.createDataFrame(list(itertools.combinations(ids, 2)), "a string, b string")
    scored = resolution.scored_pairs(every, rows, id="url").cache()
    all_ = {(r["a"], r["b"]): r for r in scored.collect()}
    group = {i: {i} for i in ids}
    edges = sorted((r for r in all_.values() if r["class"] in ("MESMO_IMOVEL", "PROVAVELMENTE_MESMO")), key=lambda r: (-r["raw"], r["a"], r["b"]))
    for e in edges:
        x, y = group[e["a"]], group[e["b"]]
        if x is not y and all(all_[(min(i, j), max(i, j))]["score"] >= 0.72 for i in x for j in y):
            x |= y
            for i in y:
                group[i] = x
    got = {r["id"]: r["cluster"] for r in resolution.clusters(scored, rows, id="url").collect()}
    assert got == {i: min(g) for i, g in group.items()}


def test_consolidation(spark):
    values = [("e", "area", v, s, n) for n, (s, v) in enumerate([("A", "72"), ("B", "75"), ("C", "72.0")])] + [("e", "preco", "70", "A", 0), ("e", "preco", "80", "B", 1)] + [("e", "bairro", "X", "A", 0), ("e", "bairro", "Y", "B", 1), ("e", "bairro", "", "C", 2), ("e", "um", "z", "A", 0)]
    trust = spark.createDataFrame([("B", 0.9)], "source string, trust double")
    got = {r["field"]: (r["value"], r["criterion"]) for r in resolution.consolidated(spark.createDataFrame(values, "entity string, field string, value string, source string, ord int"), numeric=["area", "preco"], trust=trust).collect()}
    assert got == {"area": ("72", "maioria"), "preco": ("75.00", "mediana"), "bairro": ("Y", "fonte_mais_confiavel"), "um": ("z", None)}


def test_query_string_round_trip():
    q = ListingQuery(cidade="Recife", quartos=3, max=2500.0, sinais=("novos",), ordem="preco")
    assert ListingQuery.from_query_string(q.to_query_string()) == q
    assert ListingQuery().to_query_string() == "" and ListingQuery.from_query_string("ordem=x&quartos=y") == ListingQuery()
    assert q.active_filters() == 4


def test_marks_toggle_and_ranks(spark):
    marks, keys = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("b",), ("c",)], "k string")
    assert sorted(r["k"] for r in tables.toggled(marks, keys, key="k").collect()) == ["a"]
    assert sorted(r["k"] for r in tables.toggled(marks.where("k = 'a'"), keys, key="k").collect()) == ["a", "b", "c"]
    numbers = spark.range(1000).select("id", (F.col("id") % 7).alias("g"))
    got = ranked(numbers, ["g", F.desc("id")]).orderBy("rank").collect()
    assert [(r["g"], r["id"]) for r in got] == sorted(((i % 7, i) for i in range(1000)), key=lambda x: (x[0], -x[1])) and [r["rank"] for r in got] == list(range(1000))


def test_capped_visits(spark):
    rows = spark.createDataFrame([(i, "h" if i < 5 else "g", i < 5) for i in range(8)], "i int, host string, bad boolean")
    assert [r["i"] for r in tables.capped_by_host(rows, order=["i"], host="host", failed=F.col("bad"), most=4).collect()] == [0, 1, 5, 6]


def test_streaming_events(spark, tmp_path):
    from vitrine.streaming.price_events import price_events

    spark.createDataFrame([("a", datetime(2026, 1, 1), 5.0), ("a", datetime(2026, 1, 2), 5.0), ("a", datetime(2026, 1, 3), 6.0), ("b", datetime(2026, 1, 1), None)], "key string, at timestamp, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, at timestamp, value double").parquet(str(tmp_path / "in"))
    q = price_events(stream).writeStream.format("memory").queryName("price_events").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r["value"], r["key"], r["before"]) for r in spark.table("price_events").collect())
    assert [(k, v) for v, k, _ in got] == [("a", 5.0), ("a", 6.0)] and got[1][2] == 5.0


def test_sanity_of_a_run(spark):
    rows = [("a", 1, 30, "OK"), ("a", 2, 30, "OK"), ("a", 3, 30, "OK"), ("a", 4, 2, "OK"), ("a", 5, 0, "OK"), ("a", 6, 28, "OK"), ("a", 7, 0, "BLOQUEADO"), ("b", 1, 0, "OK"), ("b", 2, 5, "FALHA"), ("b", 3, 1, "OK"), ("c", 1, None, "OK")]
    df = spark.createDataFrame(rows, "fonte string, run int, n int, s string")
    rated = quality.demoted(quality.recent_median(df, source="fonte", at="run", value="n", healthy=F.col("s") == "OK"), value="n", status=F.col("s"))
    got = {(r["fonte"], r["run"]): (r["median"], r["status"], r["reason"]) for r in rated.collect()}
    assert len(got) == len(rows)
    assert got["a", 1] == (None, "OK", None) and got["a", 4] == (30.0, "PARCIAL", "volume") and got["a", 5] == (30.0, "PARCIAL", "zero") and got["a", 6] == (30.0, "OK", None)
    assert got["a", 7] == (30.0, "BLOQUEADO", None) and got["b", 1] == (None, "OK", None) and got["b", 3] == (None, "OK", None) and got["c", 1] == (None, "OK", None)


def test_lifecycle_of_a_listing(spark):
    seen = spark.createDataFrame([("u1", "s", 1), ("u2", "s", 1), ("u2", "s", 4), ("u3", "s", 1), ("u3", "s", 3), ("u4", "z", 1), ("u5", "s", 5)], "url string, site string, run bigint")
    runs = spark.createDataFrame([(s, n) for s in "sz" for n in range(1, 6)], "site string, run bigint")
    trusted = runs.where("site = 's' and run <> 2")
    state = lambda t: {r["url"]: (r["absent"], r["status"]) for r in changes.absences(seen, runs, key="url", source="site", run="run", trusted=t).collect()}
    assert state(trusted) == {"u1": (2, "INATIVO"), "u2": (1, "SUSPEITO"), "u3": (2, "INATIVO"), "u4": (0, "ATIVO"), "u5": (0, "ATIVO")}
    assert state(None)["u4"] == (2, "INATIVO") and set(state(trusted.limit(0)).values()) == {(0, "ATIVO")}
    events = sorted((r["url"], r["run"], r["kind"]) for r in changes.lifecycle_events(seen, runs, key="url", source="site", run="run", trusted=trusted).collect())
    assert events == [("u1", 4, "SUMIU"), ("u2", 4, "REAPARECEU"), ("u3", 5, "SUMIU")]


def test_seen_flags_of_untrusted_sources_stay(spark):
    stored = spark.createDataFrame([("u1", "olx", 1, "x"), ("u2", "olx", 1, "x"), ("u3", "zap", 1, "x"), ("u4", "zap", 0, "x"), ("u5", None, 1, "x")], "url string, site string, visto int, _here string")
    batch = spark.createDataFrame([("u1",), ("u4",), (None,)], "url string")
    flags = lambda t: {r["url"]: r["visto"] for r in changes.seen_flags(stored.drop("_here"), batch, key="url", source="site", seen="visto", trusted=t).collect()}
    assert flags(spark.createDataFrame([("olx",)], "site string")) == {"u1": 1, "u2": 0, "u3": 1, "u4": 1, "u5": 1}
    assert flags(None) == {"u1": 1, "u2": 0, "u3": 0, "u4": 1, "u5": 0}
    assert flags(spark.createDataFrame([], "site string")) == {"u1": 1, "u2": 1, "u3": 1, "u4": 1, "u5": 1}


def test_yield_puts_the_least_useful_first(spark):
    stats = spark.createDataFrame([("red1", 1, 9, 3, 0, 10, "OK"), ("red2", 1, 9, 3, 0, 20, "OK"), ("one", 1, 2, 1, 0, 10, "OK"), ("none", 1, 0, 0, 0, 5, "FALHA"), ("old", 0, 1, 0, 1, 7, "OK"), ("skip", 1, 0, 0, 0, 0, "PULADO")], "site string, run int, raw int, useful int, undetermined int, seconds int, status string")
    links = spark.createDataFrame([("e1", "red1"), ("e1", "red2"), ("e2", "one")], "e string, site string")
    active = links.groupBy("site").agg(F.count("*").alias("active"))
    got = {r["site"]: r for r in quality.source_yield(stats, active, quality.exclusive_entities(links, entity="e", source="site"), source="site", run="run").collect()}
    assert [s for s, _ in sorted(got.items(), key=lambda x: x[1]["position"])] == ["old", "none", "one", "red2", "red1"]
    assert (got["one"]["exclusive"], got["red1"]["exclusive"], got["one"]["seconds_per_useful"], got["none"]["seconds_per_useful"]) == (1, 0, 10.0, None)
    assert got["none"]["failures"] == 1 and got["old"]["status"] is None and got["none"]["status"] == "FALHA"


def test_unknown_values_are_no_criteria(spark):
    rows = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, None)], "i int, x double")
    got = {r["i"]: r["s"] for r in rows.select("i", tables.scaled(F.col("x"), F.lit(10.0), F.lit(20.0), inverted=True).alias("s")).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: None}


def test_view_of_a_dwelling(spark):
    from vitrine.plans.view import listing_view, marked, scored

    none = "id bigint, titulo string, bairro string, cidade string, quartos double, area_m2 double, preco double, custo_mensal_total double, custo_completo boolean, primeiro_visto date, ultimo_visto date"
    dwellings = spark.createDataFrame([(1, None, "Centro", "Recife", 3.0, 50.0, 2000.0, 0.0, True, date(2026, 5, 2), date(2026, 5, 12)), (2, "t", None, None, None, None, None, 900.0, None, None, None)], none)
    offers = spark.createDataFrame([(1, "u1", "a", 2000.0, ["f"], None, 1, None, None), (1, "u2", "b", 1800.0, ["f", "g"], "Rua A", None, None, 4), (None, "u3", "a", 1.0, None, None, None, None, None)], "id bigint, url string, site string, preco double, fotos array<string>, logradouro string, banheiros int, vagas int, andar int")
    history = spark.createDataFrame([(1, date(2026, 8, 1), 2500.0), (1, date(2026, 8, 20), 2000.0), (1, date(2026, 8, 1), 2600.0)], "id bigint, day date, price double")
    allowed = spark.createDataFrame([("Recife", "centro")], "cidade string, bairro string")
    view = scored(listing_view(dwellings, offers, history, allowed=allowed, new_since="2026-05-01", conflicts=spark.createDataFrame([(1, "preco")], "id bigint, campo string")), rooms=3)
    got = {r["id"]: r for r in marked(view, favourites=spark.createDataFrame([(2,)], "id bigint"), discarded=spark.createDataFrame([], "id bigint")).collect()}
    one, two = got[1], got[2]
    assert (one["titulo"], one["preco"], one["url"], one["sites"], one["fontes"], one["economia"], one["fotos"], one["logradouro"], one["banheiros"], one["andar"]) == ("Apartamento", 1800.0, "u2", ["a", "b"], 2, 200.0, ["f", "g"], "Rua A", 1, 4)
    assert (one["queda"], one["queda_pct"], one["preco_m2"], one["dias"], one["novo"], one["no_recorte"], one["conflitos"], one["atende"]) == (700.0, 28, 36.0, 10, True, True, ["preco"], True)
    assert (two["preco"], two["url"], two["sites"], two["fontes"], two["queda"], two["no_recorte"], two["novo"], two["favorito"], two["descartado"], two["atende"]) == (900.0, "#", [], 1, None, False, False, True, False, False)
