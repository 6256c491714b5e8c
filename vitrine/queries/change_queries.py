"""Change logs, series, upserts, lifecycles, retention and source quality over the driver's and the listing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.urls import listing_key
from vitrine.operators import bookkeeping, changes, quality
from vitrine.operators.snapshot_changes import delivered_runs
from vitrine.queries.core_problems import KEY_SQL
from vitrine.session import bounded_lookup
from vitrine.sources.tables import table

c = F.col


def _bucketed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("user_id", "event_id", "ts", (F.floor(c("value") / 50) * 50).cast("double").alias("value"))


def change_log(spark: SparkSession, folder: str) -> DataFrame:
    """Emitted changes of each user's bucketed value."""
    # Within a bucket the value drifts by less than the tolerance at a time.
    drifting = _bucketed(spark, folder).withColumn("value", c("value") + F.pmod(c("event_id"), F.lit(7)) * 0.004)
    log = changes.change_log(drifting, key=["user_id"], order=["ts", "event_id"], value="value")
    return log.select("user_id", "event_id", "kind", "before", "value", "delta", "delta_pct")


#: The value emitted last travels along each user's events: a recursion, because slow drift must add up.
CHANGE_LOG = """
WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(floor(value / 50) * 50 AS DOUBLE) + event_id % 7 * 0.004 AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, event_id, n, value, CAST(NULL AS DOUBLE) AS before, value AS held, true AS emitted FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.event_id, e.n, e.value, w.held, CASE WHEN abs(e.value - w.held) >= 0.01 THEN e.value ELSE w.held END, abs(e.value - w.held) >= 0.01 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, event_id, CASE WHEN before IS NULL THEN 'CRIADO' ELSE 'PRECO_ALTERADO' END AS kind, before, value,
  CASE WHEN before <> 0 THEN round(value - before, 2) END AS delta, CASE WHEN before <> 0 THEN round(100 * (value - before) / before, 2) END AS delta_pct
FROM w WHERE emitted
"""


def series_last30(spark: SparkSession, folder: str) -> DataFrame:
    """The last 30 daily minima of each listing."""
    rows = table(spark, folder, "historico_precos").where("preco > 0").select(listing_key(c("url")).alias("key"), "data", "preco")
    points = changes.last_points(rows, key=["key"], day="data", value="preco")
    return points.select("key", "data", "preco", "rank")


SERIES_LAST30 = f"""
WITH d AS (SELECT {KEY_SQL.format(u="url")} AS key, data, min(preco) AS preco FROM historico_precos WHERE preco > 0 AND data IS NOT NULL GROUP BY 1, 2)
SELECT key, data, preco, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY data DESC) AS INT) AS rank FROM d) WHERE rank <= 30
"""


def price_drop(spark: SparkSession, folder: str) -> DataFrame:
    """Current price of each listing against the point before the last."""
    points = series_last30(spark, folder)
    shown = table(spark, folder, "imoveis").groupBy(listing_key(c("url")).alias("key")).agg(F.min("preco").alias("preco_atual"))
    return changes.drops(points, shown, key=["key"], value="preco", price="preco_atual").where("drop is not null").select("key", "preco_atual", "drop", "drop_pct")


PRICE_DROP = f"""
WITH p AS ({SERIES_LAST30}), s AS (SELECT {KEY_SQL.format(u="url")} AS key, min(preco) AS preco_atual FROM imoveis GROUP BY 1)
SELECT s.key, preco_atual, round(preco - preco_atual, 2) AS drop, CAST(round(100 * (preco - preco_atual) / preco) AS INT) AS drop_pct
FROM s JOIN p ON p.key = s.key AND rank = 2 WHERE preco > preco_atual
"""


def series_trend(spark: SparkSession, folder: str) -> DataFrame:
    """First against last of each listing's points."""
    return changes.trend(series_last30(spark, folder), key=["key"], day="data", value="preco").withColumn("n", c("n").cast("bigint"))


SERIES_TREND = f"""
WITH p AS ({SERIES_LAST30}), g AS (SELECT key, count(*) AS n, min(preco) AS least, max(preco) AS greatest, arg_min(preco, data) AS f, arg_max(preco, data) AS l FROM p GROUP BY 1)
SELECT key, n, least, greatest, CAST(sign(l - f) AS INT) AS trend FROM g WHERE n >= 3 AND least < greatest
"""


def upsert_listings(spark: SparkSession, folder: str) -> DataFrame:
    """The first half of the orders as stored table, the second as batch, keyed by customer."""
    half = F.lit("1995-06-17").cast("timestamp")
    dated = table(spark, folder, "orders").select(c("o_custkey").alias("k"), "o_orderkey", c("o_totalprice").alias("price"), F.when(c("o_orderstatus") != "O", c("o_orderstatus")).alias("status"), (c("o_orderdate") < half).alias("old"))
    stored = dated.where("old").groupBy("k").agg(F.max_by("price", "o_orderkey").alias("price"), F.max_by("status", "o_orderkey").alias("status"))
    return changes.upsert(stored, dated.where("not old"), key="k", order="o_orderkey", overwrite=["price"], keep_known=["status"])


UPSERT = """
WITH d AS (SELECT o_custkey AS k, o_orderkey, o_totalprice AS price, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS status, o_orderdate < TIMESTAMP '1995-06-17' AS old FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY k, old ORDER BY o_orderkey DESC, price DESC, status DESC NULLS LAST) AS rn FROM d),
s AS (SELECT * FROM r WHERE rn = 1 AND old), b AS (SELECT * FROM r WHERE rn = 1 AND NOT old)
SELECT coalesce(s.k, b.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.price ELSE s.price END AS price, coalesce(b.status, s.status) AS status, s.k IS NULL AS is_new
FROM s FULL OUTER JOIN b ON s.k = b.k
"""


def _sightings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sightings of listings, the runs of each source, and those that were healthy."""
    rows = table(spark, folder, "imoveis_snapshot").where("visto_na_ultima_execucao = 1").select(listing_key(c("url")).alias("key"), "site", c("execucao_id").alias("run"))
    healthy = table(spark, folder, "execucao").where("status = 'OK'").select(c("id").alias("run"))
    runs = rows.select("site", "run").distinct()
    return rows, runs, runs.join(healthy, "run").select("site", "run")


def lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    """Listings by the delivered runs in a row that lack them, and the state they are in."""
    rows, runs, trusted = _sightings(spark, folder)
    return changes.absences(rows, runs, key="key", source="site", run="run", trusted=trusted)


_SIGHTINGS = f"""r AS (SELECT DISTINCT {KEY_SQL.format(u="url")} AS key, site, execucao_id AS run FROM imoveis_snapshot WHERE visto_na_ultima_execucao = 1),
t AS (SELECT DISTINCT site, run FROM r WHERE run IN (SELECT id FROM execucao WHERE status = 'OK'))"""

LIFECYCLE = f"""
WITH {_SIGHTINGS},
l AS (SELECT key, site, max(run) AS last FROM r GROUP BY 1, 2),
n AS (SELECT l.key, l.site, CAST(least(count(t.run), 2) AS INT) AS absent FROM l LEFT JOIN t ON t.site = l.site AND t.run > l.last GROUP BY 1, 2)
SELECT *, CASE absent WHEN 0 THEN 'ATIVO' WHEN 1 THEN 'SUSPEITO' ELSE 'INATIVO' END AS status FROM n
"""


def lifecycle_events(spark: SparkSession, folder: str) -> DataFrame:
    """Listings that went and came back, by the run in which that shows."""
    rows, runs, trusted = _sightings(spark, folder)
    return changes.lifecycle_events(rows, runs, key="key", source="site", run="run", trusted=trusted)


LIFECYCLE_EVENTS = f"""
WITH {_SIGHTINGS},
s AS (SELECT *, lead(run) OVER (PARTITION BY key, site ORDER BY run) AS nxt FROM r),
g AS (SELECT s.key, s.site, s.nxt, t.run, row_number() OVER (PARTITION BY s.key, s.site, s.run ORDER BY t.run) AS n FROM s JOIN t ON t.site = s.site AND t.run > s.run AND (s.nxt IS NULL OR t.run < s.nxt))
SELECT key, site, run, 'SUMIU' AS kind FROM g WHERE n = 2 UNION ALL SELECT key, site, nxt, 'REAPARECEU' FROM g WHERE n = 1 AND nxt IS NOT NULL
"""


def trust_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The seen flag of every stored listing after the last snapshot, whose absences count only for sources trusted at least 0.9."""
    runs = delivered_runs(table(spark, folder, "imoveis_snapshot"), table(spark, folder, "execucao"), "execucao_id", "id", "iniciada_em")
    last = runs.agg(F.max_by("run", "seq")).first()[0]
    stored = table(spark, folder, "imoveis").select(listing_key(c("url")).alias("key"), "site", "visto_na_ultima_execucao").distinct()
    batch = table(spark, folder, "imoveis_snapshot").where((c("execucao_id") == F.lit(last)) & (c("visto_na_ultima_execucao") == 1)).select(listing_key(c("url")).alias("key"))
    return changes.seen_flags(stored, batch, key="key", source="site", seen="visto_na_ultima_execucao", trusted=table(spark, folder, "fonte").where("confianca >= 0.9"))


TRUST_GATE = f"""
WITH b AS (SELECT DISTINCT {KEY_SQL.format(u="url")} AS key FROM imoveis_snapshot WHERE visto_na_ultima_execucao = 1
 AND execucao_id = (SELECT id FROM execucao WHERE id IN (SELECT execucao_id FROM imoveis_snapshot) ORDER BY iniciada_em DESC, id DESC LIMIT 1)),
s AS (SELECT DISTINCT {KEY_SQL.format(u="url")} AS key, site, visto_na_ultima_execucao AS v FROM imoveis)
SELECT key, site, CAST(CASE WHEN key IN (SELECT key FROM b) THEN 1 WHEN site IN (SELECT site FROM fonte WHERE confianca >= 0.9) THEN 0 ELSE v END AS INT) AS visto_na_ultima_execucao FROM s
"""


def retention(spark: SparkSession, folder: str) -> DataFrame:
    """Active listings and those seen within 60 days of the last run, with the links that still have a listing."""
    rows = table(spark, folder, "imoveis")
    kept = changes.pruned(rows, inactive=c("status") == "INATIVO", last_seen=F.coalesce(F.to_date("ultima_confirmacao"), c("ultimo_visto")), run_date="2026-06-01", days=60)
    named = kept.select(listing_key(c("url")).alias("key"))
    links = table(spark, folder, "imovel_anuncio").select("imovel_id", listing_key(c("url")).alias("key"))
    return changes.without_orphans(links, named, child="key", parent="key").groupBy("key").agg(F.count("*").alias("n")).select("key", "n")


RETENTION = f"""
WITH k AS (SELECT DISTINCT {KEY_SQL.format(u="url")} AS key FROM imoveis
  WHERE NOT coalesce(status = 'INATIVO' AND date_diff('day', coalesce(CAST(ultima_confirmacao AS DATE), ultimo_visto), DATE '2026-06-01') > 60, false))
SELECT key, count(*) AS n FROM (SELECT {KEY_SQL.format(u="url")} AS key FROM imovel_anuncio) WHERE key IN (SELECT key FROM k) GROUP BY 1
"""


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def _source_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Each source in each run: listings delivered, those within a search profile, those that can't be told; a run that failed delivered none."""
    e = table(spark, folder, "execucao").select(c("id").alias("run"), "iniciada_em", "status", F.unix_timestamp("encerrada_em") - F.unix_timestamp("iniciada_em"))
    runs = F.array(*[F.struct(F.lit(r[0]).alias("run"), F.lit(r[1]).alias("at"), F.lit(r[2]).alias("status"), F.lit(r[3]).alias("length")) for r in quality.latest_runs(e, run="run", n=RUNS).join(e, "run").collect()]).cast("array<struct<run:bigint,at:timestamp,status:string,length:bigint>>")
    named = table(spark, folder, "fonte").select("site", F.explode(runs).alias("r")).select("site", "r.*")
    rows = table(spark, folder, "imoveis_snapshot")
    unknown = c("preco").isNull() | c("quartos").isNull()
    counted = rows.groupBy("site", c("execucao_id").alias("run")).agg(F.count("*").alias("raw"), F.count_if((c("preco") <= 2500) & (c("quartos") >= 2)).alias("useful"), F.count_if(unknown).alias("undetermined"))
    return named.join(counted, ["site", "run"], "left").na.fill(0, ["raw", "useful", "undetermined"]).withColumn("seconds", F.floor(c("length") / 40)).drop("length")


#: Runs that the sources are judged by; a schedule has few.
RUNS = 100

_SOURCE_RUNS = """e AS (SELECT id AS run, iniciada_em AS at, status, CAST(floor(date_diff('second', iniciada_em, encerrada_em) / 40) AS BIGINT) AS seconds FROM execucao),
k AS (SELECT site, execucao_id AS run, count(*) AS raw, count(*) FILTER (WHERE preco <= 2500 AND quartos >= 2) AS useful, count(*) FILTER (WHERE preco IS NULL OR quartos IS NULL) AS undetermined FROM imoveis_snapshot GROUP BY 1, 2),
n AS (SELECT f.site, e.*, coalesce(raw, 0) AS raw, coalesce(useful, 0) AS useful, coalesce(undetermined, 0) AS undetermined FROM fonte f CROSS JOIN e LEFT JOIN k USING (site, run))"""


def sanity_demotion(spark: SparkSession, folder: str) -> DataFrame:
    """Runs in which a source delivered nothing, or far less than the median of its last five healthy runs."""
    stats = _source_runs(spark, folder)
    rated = quality.recent_median(stats, source="site", at="run", value="raw", healthy=c("status") == "OK")
    return quality.demoted(rated, value="raw", status=c("status")).select("site", "run", "raw", "median", "status", F.coalesce("reason", F.lit("")).alias("reason"))


SANITY = f"""
WITH {_SOURCE_RUNS},
m AS (SELECT a.*, (SELECT median(raw) FROM (SELECT raw FROM n b WHERE b.site = a.site AND b.run < a.run AND b.status = 'OK' AND b.raw > 0 ORDER BY b.run DESC LIMIT 5)) AS median FROM n a)
SELECT site, run, raw, CAST(median AS DOUBLE) AS median, CASE WHEN status = 'OK' AND (raw = 0 AND median IS NOT NULL OR raw < 0.6 * median) THEN 'PARCIAL' ELSE status END AS status,
 CASE WHEN status = 'OK' AND raw = 0 AND median IS NOT NULL THEN 'zero' WHEN status = 'OK' AND raw < 0.6 * median THEN 'volume' ELSE '' END AS reason FROM m
"""


def sanity_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Days on which a user's events fall far below the median of the five before."""
    rated = quality.recent_median(_daily(spark, folder), source="user_id", at="day", value="n")
    return quality.demoted(rated, value="n").select("user_id", "day", "n", "median", "status")


SANITY_DAILY = """
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2),
m AS (SELECT *, CAST(median(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS DOUBLE) AS median FROM d)
SELECT user_id, day, n, median, CASE WHEN n < 0.6 * median THEN 'PARCIAL' ELSE 'OK' END AS status FROM m
"""


def source_yield(spark: SparkSession, folder: str) -> DataFrame:
    """What each source costs and brings over the last ten runs and in the current stock, the worst first."""
    listings = table(spark, folder, "imoveis").where("visto_na_ultima_execucao = 1").select(listing_key(c("url")).alias("key"), "site").distinct()
    entity = table(spark, folder, "imovel_anuncio").groupBy(listing_key(c("url")).alias("key")).agg(F.min("imovel_id").alias("imovel_id"))
    exclusive = quality.exclusive_entities(listings.join(entity, "key"), entity="imovel_id", source="site")
    active = listings.groupBy("site").agg(F.count("*").alias("active"))
    return quality.source_yield(_source_runs(spark, folder).drop("at"), active, exclusive, source="site", run="run")


SOURCE_YIELD = f"""
WITH {_SOURCE_RUNS},
l AS (SELECT DISTINCT {KEY_SQL.format(u="url")} AS key, site FROM imoveis WHERE visto_na_ultima_execucao = 1),
i AS (SELECT {KEY_SQL.format(u="url")} AS key, min(imovel_id) AS imovel_id FROM imovel_anuncio GROUP BY 1),
x AS (SELECT site, count(*) AS exclusive FROM (SELECT imovel_id, min(site) AS site FROM l JOIN i USING (key) GROUP BY 1 HAVING count(DISTINCT site) = 1) GROUP BY 1),
t AS (SELECT site, count(*) AS runs, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(useful) AS BIGINT) AS useful, CAST(sum(undetermined) AS BIGINT) AS undetermined, CAST(sum(seconds) AS BIGINT) AS seconds,
 count(*) FILTER (WHERE status IN ('FALHA', 'BLOQUEADO')) AS failures FROM n WHERE run IN (SELECT run FROM e ORDER BY run DESC LIMIT 10) AND status <> 'PULADO' GROUP BY 1),
a AS (SELECT site, count(*) AS active FROM l GROUP BY 1),
y AS (SELECT t.*, coalesce(active, 0) AS active, coalesce(exclusive, 0) AS exclusive, (SELECT status FROM e ORDER BY run DESC LIMIT 1) AS status, CASE WHEN useful > 0 THEN round(seconds / useful, 1) END AS seconds_per_useful FROM t LEFT JOIN a USING (site) LEFT JOIN x USING (site))
SELECT *, CAST(row_number() OVER (ORDER BY useful, exclusive, seconds DESC, site) AS INT) AS position FROM y
"""


def source_bars(spark: SparkSession, folder: str) -> DataFrame:
    """The yield of each source as bars against the best, the seconds spent for nothing, and warnings."""
    return bookkeeping.yield_bars(source_yield(spark, folder)).select("site", "useful_bar", "exclusive_bar", "wasted", "warning")


SOURCE_BARS = f"""
WITH y AS ({SOURCE_YIELD}), b AS (SELECT max(useful) AS u, max(exclusive) AS e, CAST(coalesce(sum(seconds) FILTER (WHERE useful = 0), 0) AS DOUBLE) AS wasted FROM y)
SELECT site, CAST(greatest(round_even(100 * useful / CAST(CASE WHEN u = 0 THEN 1 ELSE u END AS DOUBLE), 0), 2) AS INT) AS useful_bar, CAST(greatest(round_even(100 * exclusive / CAST(CASE WHEN e = 0 THEN 1 ELSE e END AS DOUBLE), 0), 2) AS INT) AS exclusive_bar, wasted,
 useful = 0 AND seconds >= 20 AS warning FROM y, b
"""


def source_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The sources of each run, those that delivered most first."""
    return bookkeeping.source_summary(_source_runs(spark, folder), source="site", run="run", raw="raw").select("site", "run", "raw", "position")


SOURCE_SUMMARY = f"""WITH {_SOURCE_RUNS} SELECT site, run, raw, CAST(row_number() OVER (PARTITION BY run ORDER BY raw DESC, site) AS INT) AS position FROM n"""


def run_health(spark: SparkSession, folder: str) -> DataFrame:
    """Each run with the sources that went wrong in it."""
    return quality.run_health(sanity_demotion(spark, folder), run="run", status="status", source="site").select("run", "status", "ok", F.array_join("degraded", "|").alias("degraded"))


RUN_HEALTH = f"""
WITH s AS ({SANITY}), g AS (SELECT run, count(*) FILTER (WHERE status = 'OK') AS ok, coalesce(list_sort(list_distinct(list(site) FILTER (WHERE status IN ('FALHA', 'BLOQUEADO', 'PARCIAL')))), []) AS d FROM s GROUP BY 1)
SELECT run, CASE WHEN len(d) > 0 THEN 'PARCIAL' ELSE 'OK' END AS status, ok, array_to_string(d, '|') AS degraded FROM g
"""


def source_exclusive(spark: SparkSession, folder: str) -> DataFrame:
    """Orders that a single supplier serves, per supplier."""
    return quality.exclusive_entities(table(spark, folder, "lineitem"), entity="l_orderkey", source="l_suppkey").select("l_suppkey", "exclusive")


SOURCE_EXCLUSIVE = """
SELECT l_suppkey, count(*) AS exclusive FROM (SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1) GROUP BY 1
"""

QUERIES = {
    "change_log": (change_log, CHANGE_LOG),
    "series_last30": (series_last30, SERIES_LAST30),
    "price_drop": (price_drop, PRICE_DROP),
    "series_trend": (series_trend, SERIES_TREND),
    "upsert_listings": (upsert_listings, UPSERT),
    "lifecycle": (lifecycle, LIFECYCLE),
    "lifecycle_events": (lifecycle_events, LIFECYCLE_EVENTS),
    "trust_gate": (trust_gate, TRUST_GATE),
    "run_health": (run_health, RUN_HEALTH),
    "source_bars": (source_bars, SOURCE_BARS),
    "source_summary": (source_summary, SOURCE_SUMMARY),
    "sanity_daily": (sanity_daily, SANITY_DAILY),
    "retention": (retention, RETENTION),
    "sanity_demotion": (sanity_demotion, SANITY),
    "source_yield": (source_yield, SOURCE_YIELD),
    "source_exclusive": (source_exclusive, SOURCE_EXCLUSIVE),
}


def snapshot_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events between the first and the last delivered snapshot, one row per listing; those between all snapshots are in :func:`snapshot_event_log`."""
    from vitrine.operators.tables import first_per_key

    runs = delivered_runs(table(spark, folder, "imoveis_snapshot"), table(spark, folder, "execucao"), "execucao_id", "id", "iniciada_em")
    first, last = runs.agg(F.min_by("run", "seq"), F.max_by("run", "seq")).first()
    rows = table(spark, folder, "imoveis_snapshot").select(listing_key(c("url")).alias("key"), "execucao_id", "preco", F.lower("titulo").alias("titulo"), "entregue_em")
    at = lambda run: first_per_key(rows.where(c("execucao_id") == F.lit(run)), key=["key"], order=[c("entregue_em").desc(), c("preco").desc(), c("titulo").desc()])
    events = changes.listing_events(at(first), at(last), key="key", price="preco", texts={"titulo": "DESCRICAO_ALTERADA"})
    return events.select("key", "kind", "field", F.when(c("field") == "preco", c("after")).alias("after"), "delta", "delta_pct")


SNAPSHOT_EVENTS = f"""
WITH s AS (SELECT {KEY_SQL.format(u="url")} AS key, execucao_id AS r, nullif(preco, 0) AS p, nullif(lower(trim(regexp_replace(titulo, '\\s+', ' ', 'g'))), '') AS t,
  row_number() OVER (PARTITION BY {KEY_SQL.format(u="url")}, execucao_id ORDER BY entregue_em DESC, preco DESC, lower(titulo) DESC) AS rn FROM imoveis_snapshot),
a AS (SELECT * FROM s WHERE rn = 1 AND r = 401), b AS (SELECT b.*, a.key IS NOT NULL AS known, a.p AS op, a.t AS ot FROM s b LEFT JOIN a ON a.key = b.key WHERE b.rn = 1 AND b.r = 415)
SELECT key, 'CRIADO' AS kind, 'preco' AS field, CASE WHEN p IS NOT NULL THEN printf('%.2f', p) END AS after, NULL::DOUBLE AS delta, NULL::DOUBLE AS delta_pct FROM b WHERE NOT known
UNION ALL SELECT key, 'PRECO_ALTERADO', 'preco', printf('%.2f', p), round(p - op, 2), round(100 * (p - op) / op, 2) FROM b WHERE known AND round(abs(p - op), 9) >= 0.01
UNION ALL SELECT key, 'DESCRICAO_ALTERADA', 'titulo', NULL, NULL, NULL FROM b WHERE known AND t <> ot
"""
QUERIES["snapshot_events"] = (snapshot_events, SNAPSHOT_EVENTS)


def snapshot_event_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each listing between all consecutive delivered snapshots."""
    snapshots = table(spark, folder, "imoveis_snapshot")
    runs = bounded_lookup(delivered_runs(snapshots, table(spark, folder, "execucao"), "execucao_id", "id", "iniciada_em"))
    valid = F.max(F.struct("entregue_em", F.nanvl("preco", F.lit(None).cast("double")).alias("preco"), F.lower("titulo").alias("titulo"), c("visto_na_ultima_execucao").alias("visto"))).alias("row")
    keyed = snapshots.withColumns({"key": listing_key(c("url")), "run": c("execucao_id")}).where("key is not null").join(runs, "run")
    rows = keyed.groupBy("key", "seq").agg(valid).where("row.visto = 1").select("key", "seq", "row.preco", "row.titulo")
    last = runs.agg(F.max("seq")).first()[0] or 0
    events = changes.snapshot_log(rows, key="key", seq="seq", last=last, price="preco", texts={"titulo": "DESCRICAO_ALTERADA"})
    return events.join(runs, "seq").select(c("run").alias("execucao_id"), "key", "kind", "field", F.when(c("field") == "preco", c("after")).alias("after"), "delta", "delta_pct")


SNAPSHOT_EVENT_LOG = f"""
WITH d AS (SELECT id AS r, row_number() OVER (ORDER BY min(iniciada_em), id) AS seq FROM execucao WHERE iniciada_em IS NOT NULL AND id IN (SELECT execucao_id FROM imoveis_snapshot) GROUP BY 1),
v AS (SELECT {KEY_SQL.format(u="url")} AS key, r, seq, CASE WHEN NOT isnan(preco) THEN preco END AS preco, lower(titulo) AS titulo, visto_na_ultima_execucao AS visto, entregue_em FROM imoveis_snapshot JOIN d ON r = execucao_id),
w AS (SELECT *, row_number() OVER (PARTITION BY key, seq ORDER BY entregue_em DESC NULLS LAST, preco DESC NULLS LAST, titulo DESC NULLS LAST, visto DESC NULLS LAST) AS rn FROM v WHERE key IS NOT NULL),
s AS (SELECT key, r, seq, nullif(preco, 0) AS p, nullif(trim(regexp_replace(titulo, '\\s+', ' ', 'g')), '') AS t, min(seq) OVER (PARTITION BY key) AS born FROM w WHERE rn = 1 AND visto = 1),
b AS (SELECT s.*, a.key IS NOT NULL AS known, a.p AS op, a.t AS ot FROM s LEFT JOIN s a ON a.key = s.key AND a.seq = s.seq - 1 WHERE s.seq > 1)
SELECT r AS execucao_id, key, CASE WHEN seq = born THEN 'CRIADO' ELSE 'REAPARECEU' END AS kind, 'preco' AS field, CASE WHEN p IS NOT NULL THEN printf('%.2f', p) END AS after, NULL::DOUBLE AS delta, NULL::DOUBLE AS delta_pct FROM b WHERE NOT known
UNION ALL SELECT r, key, 'PRECO_ALTERADO', 'preco', printf('%.2f', p), round(p - op, 2), round(100 * (p - op) / op, 2) FROM b WHERE known AND round(abs(p - op), 9) >= 0.01
UNION ALL SELECT r, key, 'DESCRICAO_ALTERADA', 'titulo', NULL, NULL, NULL FROM b WHERE known AND t <> ot
UNION ALL SELECT d.r, s.key, 'SUMIU', NULL, NULL, NULL, NULL FROM s JOIN d ON d.seq = s.seq + 1 WHERE NOT EXISTS (SELECT 1 FROM s n WHERE n.key = s.key AND n.seq = s.seq + 1)
"""
QUERIES["snapshot_event_log"] = (snapshot_event_log, SNAPSHOT_EVENT_LOG)


def daily_minimum(spark: SparkSession, folder: str) -> DataFrame:
    """Least price of a dwelling on each day over its listings, the last 30 days."""
    links = table(spark, folder, "imovel_anuncio").select("imovel_id", listing_key(c("url")).alias("key")).distinct()
    prices = table(spark, folder, "historico_precos").where("preco > 0").select(listing_key(c("url")).alias("key"), "data", "preco")
    return changes.last_points(links.join(prices, "key"), key=["imovel_id"], day="data", value="preco").select("imovel_id", "data", "preco", "rank")


DAILY_MINIMUM = f"""
WITH l AS (SELECT DISTINCT imovel_id, {KEY_SQL.format(u="url")} AS k FROM imovel_anuncio), p AS (SELECT {KEY_SQL.format(u="url")} AS k, data, preco FROM historico_precos WHERE preco > 0),
d AS (SELECT imovel_id, data, min(preco) AS preco FROM l JOIN p USING (k) GROUP BY 1, 2)
SELECT imovel_id, data, preco, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY imovel_id ORDER BY data DESC) AS INT) AS rank FROM d) WHERE rank <= 30
"""
QUERIES["daily_minimum"] = (daily_minimum, DAILY_MINIMUM)
