"""Queries of problems 1, 2 and 5 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.urls import listing_key
from vitrine.operators.attribute_history import observations, versions
from vitrine.operators.nearby import near_pairs, usable
from vitrine.operators.regions import containing_regions
from vitrine.operators.snapshot_changes import snapshot_changes
from vitrine.sources.tables import table


def listing_names(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """``(key, url, ...)``: the reference spelling of each listing, one row per key."""
    cols = [F.min(c).alias(c) for c in ("url", *extra)]
    return table(spark, folder, "imoveis").where("url is not null").select(listing_key(F.col("url")).alias("key"), "url", *extra).groupBy("key").agg(*cols)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Added, removed and changed listings between consecutive snapshots."""
    title = F.lower(F.regexp_replace(F.trim("titulo"), r"\s+", " "))
    found = snapshot_changes(
        table(spark, folder, "imoveis_snapshot"),
        table(spark, folder, "execucao"),
        run_id="execucao_id",
        runs_id="id",
        runs_order="iniciada_em",
        key=listing_key(F.col("url")),
        arrived="entregue_em",
        present=F.col("visto_na_ultima_execucao") == 1,
        texts={"titulo": title},
        numbers={"preco": F.col("preco"), "quartos": F.col("quartos"), "area_m2": F.col("area_m2")},
    )
    return found.join(listing_names(spark, folder), "key").select(F.col("run").alias("execucao_id"), "url", F.col("change").alias("mudanca"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Price versions of each listing."""
    seen = observations(table(spark, folder, "historico_precos"), entity=listing_key(F.col("url")), day=F.col("data"), value=F.col("preco"), recorded=F.col("registrado_em"))
    names = listing_names(spark, folder, "primeiro_visto", "ultimo_visto")
    bounds = names.select(F.col("key").alias("entity"), "url", F.col("primeiro_visto").alias("since"), F.col("ultimo_visto").alias("until"))
    v = versions(seen, bounds)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return v.select("url", day("valid_from").alias("valido_de"), day("valid_to").alias("valido_ate"), F.round(F.col("value") * 100).cast("bigint").alias("preco_centavos"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of listings at most 50 metres apart."""
    pairs = near_pairs(table(spark, folder, "imoveis"), id=F.col("url"), lat=F.col("latitude"), lon=F.col("longitude"), radius=50.0)
    return pairs.select(F.col("a").alias("url_a"), F.col("b").alias("url_b"))


#: Degrees of the squares and triangles of p5_regions, and where their corners lie (off the decimals that coarse coordinates have).
SQUARE, TRIANGLE, CORNER = 0.1, 0.02, 0.00371


def p5_regions(spark: SparkSession, folder: str) -> DataFrame:
    """The square, and the lower left triangle, that each listing lies in, of those that any listing is near."""
    c = F.col
    listings = table(spark, folder, "imoveis").where("url is not null").select("url", "latitude", "longitude").where(usable(c("latitude"), c("longitude"))).distinct()
    cell = lambda name, size: F.floor((c(name) + CORNER) / size).cast("long")
    at = lambda name, size, n: (c(name) + n) * size - CORNER
    point = lambda size, y, x: F.struct(at("y", size, y).alias("lat"), at("x", size, x).alias("lon"))
    kinds = []
    for kind, size, corners in (("q", SQUARE, ((0, 0), (0, 1), (1, 1), (1, 0))), ("t", TRIANGLE, ((0, 0), (0, 1), (1, 0)))):
        held = listings.select(cell("latitude", size).alias("y"), cell("longitude", size).alias("x")).distinct()
        kinds.append(held.select(F.concat_ws(":", F.lit(kind), "y", "x").alias("region"), F.array(*[point(size, y, x) for y, x in corners]).alias("ring")))
    found = containing_regions(listings, kinds[0].unionByName(kinds[1]), id=c("url"), lat=c("latitude"), lon=c("longitude"), region=c("region"), ring=c("ring"))
    return found.select(c("id").alias("url"), c("region").alias("regiao"))


#: DuckDB macro-free spelling of listing_key.
KEY_SQL = r"""regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(trim({u}), '^[A-Za-z]+://', ''), '^([^/?#]*)', 1)), '^www\.', ''), ':[0-9]*$', '')
 || regexp_replace(regexp_extract(regexp_replace(trim({u}), '^[A-Za-z]+://', ''), '^[^/?#]*([^?#]*)', 1), '/+$', '')
 || regexp_extract(trim({u}), '[?]id=[0-9]+')"""

P1_SQL = f"""
WITH runs AS (SELECT id, row_number() OVER (ORDER BY iniciada_em, id) AS seq FROM execucao WHERE id IN (SELECT execucao_id FROM imoveis_snapshot)),
s AS (SELECT {KEY_SQL.format(u="url")} AS k, r.seq, visto_na_ultima_execucao AS v, lower(trim(regexp_replace(titulo, '\\s+', ' ', 'g'))) AS t, preco, quartos, area_m2, entregue_em
      FROM imoveis_snapshot JOIN runs r ON r.id = execucao_id),
d AS (SELECT *, row_number() OVER (PARTITION BY k, seq ORDER BY entregue_em DESC NULLS LAST, t DESC, preco DESC) AS rn FROM s),
x AS (SELECT * FROM d WHERE rn = 1 AND v = 1),
n AS (SELECT {KEY_SQL.format(u="url")} AS k, min(url) AS url FROM imoveis GROUP BY 1),
c AS (SELECT b.k, b.seq, CASE WHEN a.k IS NULL THEN 'ADICIONADO' ELSE 'ALTERADO' END AS mudanca FROM x b LEFT JOIN x a ON a.k = b.k AND a.seq = b.seq - 1
      WHERE b.seq > 1 AND (a.k IS NULL OR a.t IS DISTINCT FROM b.t
        OR (a.preco IS NULL) <> (b.preco IS NULL) OR round(abs(a.preco - b.preco), 9) >= 0.01
        OR (a.quartos IS NULL) <> (b.quartos IS NULL) OR abs(a.quartos - b.quartos) >= 0.01
        OR (a.area_m2 IS NULL) <> (b.area_m2 IS NULL) OR round(abs(a.area_m2 - b.area_m2), 9) >= 0.01)
      UNION ALL
      SELECT a.k, a.seq + 1, 'REMOVIDO' FROM x a WHERE a.seq < (SELECT max(seq) FROM runs) AND NOT EXISTS (SELECT 1 FROM x b WHERE b.k = a.k AND b.seq = a.seq + 1))
SELECT r.id AS execucao_id, n.url, c.mudanca FROM c JOIN runs r USING (seq) JOIN n USING (k)
"""

P2_SQL = f"""
WITH n AS (SELECT {KEY_SQL.format(u="url")} AS k, min(url) AS url, min(primeiro_visto) AS d0, min(ultimo_visto) AS d1 FROM imoveis GROUP BY 1),
o AS (SELECT n.url, n.d1, h.data, h.preco, row_number() OVER (PARTITION BY n.url, h.data ORDER BY registrado_em DESC, preco DESC) AS rn
      FROM (SELECT *, {KEY_SQL.format(u="url")} AS k FROM historico_precos) h JOIN n USING (k) WHERE h.data BETWEEN n.d0 AND n.d1 AND h.preco > 0),
l AS (SELECT *, lag(preco) OVER (PARTITION BY url ORDER BY data) AS antes FROM o WHERE rn = 1),
v AS (SELECT * FROM l WHERE antes IS NULL OR round(abs(preco - antes), 9) >= 0.01)
SELECT url, strftime(data, '%Y-%m-%d') AS valido_de,
       strftime(coalesce((lead(data) OVER (PARTITION BY url ORDER BY data) - INTERVAL 1 DAY)::DATE, d1), '%Y-%m-%d') AS valido_ate,
       CAST(round(preco * 100) AS BIGINT) AS preco_centavos
FROM v
"""

P5_SQL = """
WITH t AS (SELECT DISTINCT url, latitude AS la, longitude AS lo FROM imoveis
           WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0)),
g AS (SELECT *, floor(la / 0.00045)::BIGINT AS y, floor(lo / 0.00046)::BIGINT AS x FROM t),
m AS (SELECT url, la, lo, y + dy AS y, x + dx AS x FROM g, (VALUES (-1), (0), (1)) p(dy), (VALUES (-1), (0), (1)) q(dx))
SELECT DISTINCT g.url AS url_a, m.url AS url_b FROM g JOIN m USING (y, x)
WHERE g.url < m.url AND 2 * 6371000 * asin(sqrt(pow(sin(radians(g.la - m.la) / 2), 2) + cos(radians(g.la)) * cos(radians(m.la)) * pow(sin(radians(g.lo - m.lo) / 2), 2))) <= 50
"""

P5_REGIONS_SQL = f"""
WITH t AS (SELECT DISTINCT url, latitude + {CORNER} AS la, longitude + {CORNER} AS lo FROM imoveis
           WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0))
SELECT url, 'q:' || CAST(floor(la / {SQUARE}) AS BIGINT) || ':' || CAST(floor(lo / {SQUARE}) AS BIGINT) AS regiao FROM t
UNION ALL SELECT url, 't:' || CAST(floor(la / {TRIANGLE}) AS BIGINT) || ':' || CAST(floor(lo / {TRIANGLE}) AS BIGINT) FROM t
WHERE la / {TRIANGLE} - floor(la / {TRIANGLE}) + lo / {TRIANGLE} - floor(lo / {TRIANGLE}) < 1
"""

QUERIES = {"p1_found": (p1_found, P1_SQL), "p2_found": (p2_found, P2_SQL), "p5_found": (p5_found, P5_SQL), "p5_regions": (p5_regions, P5_REGIONS_SQL)}
