"""Entity resolution over listings: blocking, scoring, constrained clustering, consolidation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.similarity import MatchPolicy, compared, cost, photo_names, prepared
from vitrine.functions.text import digits, plain_words
from vitrine.session import discard, materialize, materialize_at

#: Members above which a block is cut by finer keys: such a key says too little (a property of the method).
BLOCK_CAP = 60
#: Relative widths of the cost and area bands that cut large blocks: from these differences on, a comparison of cost or area gives nothing.
FINER = {"custo": 0.15, "area": 0.12}


def block_keys() -> Column:
    """Array of the blocking keys of a listing; unknown rooms block together under -1."""
    c = lambda n: F.col(n)
    rooms = F.coalesce(c("quartos"), F.lit(-1)).cast("string")
    plain = lambda x: F.when(x != "", plain_words(x))
    key = lambda kind, *parts: F.when(_known(*parts), F.concat_ws("|", F.lit(kind), *parts))
    band = F.bround(c("area_m2") / 5) * 5
    areas = [F.when(c("area_m2") != 0, key("bairro", plain(c("bairro")), rooms, (band + d).cast("int").cast("string"))) for d in (-5, 0, 5)]
    price = F.when(c("custo_mensal_total") != 0, F.bround(c("custo_mensal_total") / 100).cast("int").cast("string"))
    single = [
        key("geo", F.format_number(F.bround("latitude", 3), 3), F.format_number(F.bround("longitude", 3), 3), rooms),
        key("rua", plain(c("logradouro")), F.coalesce(c("numero").cast("string"), F.lit(""))),
        *areas,
        key("condominio", plain(c("condominio_nome")), rooms),
        key("fone", F.right(digits(c("telefone")), F.lit(8)), rooms, price),
    ]
    photos = F.transform(F.coalesce(photo_names(c("fotos")), F.array().cast("array<string>")), lambda h: F.concat(F.lit("foto|"), h))
    return F.array_distinct(F.concat(F.array_compact(F.array(*single)), photos))


def finer_keys() -> list[Column]:
    """Bands of cost, then of area, for :func:`blocked_pairs`: two listings less than a band's width apart share one; unknown values share their own."""
    return [F.coalesce(F.when(x > 0, F.transform(F.array(F.lit(0), F.lit(1)), lambda d: (F.floor(F.log(x) / -math.log1p(-w)) + d).cast("string"))), F.array(F.lit("?"))) for x, w in ((cost(F.col("custo_mensal_total"), F.col("preco")), FINER["custo"]), (F.col("area_m2"), FINER["area"]))]


def blocked_listings(listings: DataFrame, *, id: str, cap: int | None = BLOCK_CAP) -> DataFrame:
    """:func:`blocked_pairs` of listings by :func:`block_keys`, large blocks cut by :func:`finer_keys`."""
    # Written, because every level of keys reads it, and the keys fill a generated class of their own.
    keyed = materialize(listings.select(id, block_keys().alias("keys"), *[x.alias(f"finer_{n}") for n, x in enumerate(finer_keys())]), "block-keys")
    return blocked_pairs(keyed, id=id, keys="keys", finer=["finer_0", "finer_1"], cap=cap)


def _known(*parts: Column) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p.isNotNull()
    return out


def blocked_pairs(keyed: DataFrame, *, id: str, keys: str, finer: list[str] = (), cap: int | None = BLOCK_CAP) -> DataFrame:
    """``(a, b)``, a < b: distinct pairs that share a key of at most ``cap`` members.

    A larger block is cut by the keys of the first ``finer`` column (array of
    strings), what is still larger by the next one; so of a large block the
    pairs that also share finer keys are kept, however large it is. Only blocks
    over the cap by all keys are left out. Block sizes are map-side combined
    counts and cut before pairs are formed, so pairs stay linear in the rows.
    ``cap`` is the method's own bound, None pairs every block.
    """
    rows = keyed.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), *finer, F.explode(keys).alias("key")).distinct()
    kept = []
    for column in (*finer, None):
        sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        small = sizes if cap is None else sizes.where(F.col("n") <= cap)
        kept.append(rows.join(small.select("key"), "key", "left_semi").select("id", "key"))
        if column is None or cap is None:
            break
        large = rows.join(sizes.where(F.col("n") > cap).select("key"), "key", "left_semi")
        rows = large.withColumn("_f", F.explode(column)).withColumn("key", F.concat_ws("|", "key", F.lit(column), "_f")).drop("_f")
    held = reduce(DataFrame.unionByName, kept)
    a, b = held.select("key", F.col("id").alias("a")), held.select("key", F.col("id").alias("b"))
    return a.join(b, "key").where("a < b").select("a", "b").distinct()


def scored_pairs(pairs: DataFrame, listings: DataFrame, *, id: str, policy: MatchPolicy | None = None) -> DataFrame:
    """``(a, b, raw, score, class, signals, veto, n)`` for pairs of listing ids.

    Readings and scored pairs are written: what a caller asks of the score
    would else be pushed down into the comparators, each evaluated many times.
    """
    return materialize(scored_readings(pairs, materialize(readings(listings, id=id), "readings"), policy=policy), "scored-pairs")


def readings(listings: DataFrame, *, id: str) -> DataFrame:
    """``(id, row)``: what the comparators need of each listing."""
    return listings.select(F.col(id).alias("id"), prepared().alias("row"))


def scored_readings(pairs: DataFrame, rows: DataFrame, *, policy: MatchPolicy | None = None) -> DataFrame:
    """:func:`scored_pairs` over the table of :func:`readings`."""
    left, right = rows.select(F.col("id").alias("a"), F.col("row").alias("ra")), rows.select(F.col("id").alias("b"), F.col("row").alias("rb"))
    return compared(pairs.select("a", "b").join(left, "a").join(right, "b"), policy)


def clusters(edges: DataFrame, listings: DataFrame, *, id: str, policy: MatchPolicy | None = None) -> DataFrame:
    """``(id, cluster)``: greedy clustering in which a merge needs every cross pair to reach ``probably_same``.

    Equals taking the accepted edges one by one in falling score (ties: smaller
    ids first) and merging two clusters if all their cross pairs are similar
    enough. An edge that comes first among all edges of both its clusters
    depends on no other, so all such edges are decided at once, round after
    round; a merge that fails takes its clusters' edges away. Cross pairs are
    scored even if no block joined them. Clusters hold at most one listing per
    source (the veto), which bounds a round's cross pairs. ``cluster`` is the
    smallest id.
    """
    policy = policy or MatchPolicy()
    spark = listings.sparkSession
    rows, rows_path = materialize_at(readings(listings, id=id), "readings")
    members, member_path = materialize_at(listings.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(id).alias("cluster")).distinct(), "clusters")
    accepted = edges.where(F.col("class").isin("MESMO_IMOVEL", "PROVAVELMENTE_MESMO")).select("a", "b", "raw")
    left, edge_path = materialize_at(accepted, "cluster-edges")
    while not left.isEmpty():
        of = lambda side, name: members.select(F.col("id").alias(side), F.col("cluster").alias(name))
        seen = left.join(of("a", "ca"), "a").join(of("b", "cb"), "b").where("ca <> cb")
        seen = seen.select("a", "b", "raw", F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y"))
        live, live_path = materialize_at(seen, "live-edges")
        first = F.min(F.struct((-F.col("raw")).alias("o"), "a", "b", "x", "y")).alias("e")
        ends = live.select("*", F.explode(F.array("x", "y")).alias("c")).groupBy("c").agg(first)
        chosen = ends.groupBy("e").count().where("count = 2").select("e.x", "e.y")
        sides = lambda c, m: members.select(F.col("cluster").alias(c), F.col("id").alias(m))
        cross = chosen.join(sides("x", "i"), "x").join(sides("y", "j"), "y").select("x", "y", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
        scores = cross.join(scored_readings(cross.select("a", "b").distinct(), rows, policy=policy).select("a", "b", "score"), ["a", "b"])
        verdict = scores.groupBy("x", "y").agg(F.min("score").alias("least"))
        decided, decided_path = materialize_at(verdict, "decided")
        moves = decided.where(F.col("least") >= policy.probably_same).select(F.col("y").alias("cluster"), F.col("x").alias("to"))
        members_next, member_next = materialize_at(members.join(moves, "cluster", "left").select("id", F.coalesce("to", "cluster").alias("cluster")), "clusters")
        left_next, edge_next = materialize_at(live.join(decided, ["x", "y"], "left_anti").select("a", "b", "raw"), "cluster-edges")
        for p in (member_path, edge_path, live_path, decided_path):
            discard(spark, p)
        members, member_path, left, edge_path = members_next, member_next, left_next, edge_next
    discard(spark, rows_path)
    return members


def consolidated(values: DataFrame, *, numeric: list[str], trust: DataFrame | None = None, default_trust: float = 0.8) -> DataFrame:
    """``(entity, field, value, criterion, offered)``: one value per entity and field, and how it was found.

    ``values``: ``entity, field, value (string), source, ord``; null and ''
    give nothing. One distinct value (numbers at two decimals) stands as it is,
    criterion null; a single most frequent value said more than once is
    'maioria'; otherwise numbers take the 'mediana' of all values and texts the
    value of the most trusted source (ties: the first by ``ord``).
    ``offered``: map of source to its last value where values differ.
    """
    given = values.where("entity is not null and field is not null and value is not null and value <> ''")
    number = F.col("field").isin(numeric)
    amount = F.when(number, F.round(F.col("value").try_cast("double"), 2))
    given = given.withColumns({"amount": amount, "same": F.coalesce(amount.cast("string"), "value")})
    trusted = given.join(trust, "source", "left") if trust is not None else given.withColumn("trust", F.lit(None).cast("double"))
    trusted = trusted.withColumn("trust", F.coalesce("trust", F.lit(default_trust)))
    said = trusted.groupBy("entity", "field", "same").agg(F.count("*").alias("n"), F.min(F.struct("ord", "value")).alias("first"))
    # How many values are said n times, so that a tie shows without holding all counts of a field.
    often = said.groupBy("entity", "field", "n").agg(F.count("*").alias("k"), F.min("first").alias("first"))
    top = often.groupBy("entity", "field").agg(F.max(F.struct("n", "k", F.col("first.value").alias("value"))).alias("top"), F.sum("k").alias("distinct"))
    all_values = trusted.groupBy("entity", "field").agg(F.expr("percentile(amount, 0.5)").alias("median"), F.max(F.struct("trust", (-F.col("ord")).alias("o"), "value")).alias("best"))
    last = trusted.groupBy("entity", "field", "source").agg(F.max(F.struct("ord", "value")).alias("v")).groupBy("entity", "field").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", F.col("v.value").alias("value"))))).alias("offered"))
    both = top.join(all_values, ["entity", "field"]).join(last, ["entity", "field"])
    majority = (F.col("top.n") > 1) & (F.col("top.k") == 1)
    value = F.when((F.col("distinct") == 1) | majority, F.col("top.value")).when(F.col("median").isNotNull(), F.format_string("%.2f", "median")).otherwise(F.col("best.value"))
    criterion = F.when(F.col("distinct") == 1, F.lit(None).cast("string")).when(majority, "maioria").when(F.col("median").isNotNull(), "mediana").otherwise("fonte_mais_confiavel")
    return both.select("entity", "field", value.alias("value"), criterion.alias("criterion"), F.when(F.col("distinct") > 1, F.col("offered")).alias("offered"))
