"""Filters, enrichment, the listing query, scoring and consolidation over the listing tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.similarity import MatchPolicy
from vitrine.functions.text import ABBREVIATIONS, is_dwelling, is_recent
from vitrine.functions.urls import listing_key
from vitrine.operators import bookkeeping, resolution, tables
from vitrine.operators.total_order import ranked
from vitrine.plans.listing_query import ListingQuery, badges, facet, pulse, scope_counts
from vitrine.plans.pipeline import entities_of
from vitrine.plans.view import listing_view, marked, scored
from vitrine.queries.core_problems import KEY_SQL
from vitrine.session import materialize
from vitrine.sources.sinks import json_rows
from vitrine.sources.tables import table

c = F.col


def verdict3(spark: SparkSession, folder: str) -> DataFrame:
    """Three-state filter of the parts; every seventh size and every fifth price counts as unknown."""
    p = table(spark, folder, "part").select("p_partkey", "p_type", F.when(c("p_size") % 7 != 0, c("p_size")).alias("size"), F.when(c("p_partkey") % 5 != 0, c("p_retailprice")).alias("price"))
    profiles = table(spark, folder, "part").groupBy("p_type").agg(F.min("p_size").alias("least")).where("p_type like 'S%' or p_type like 'E%'")
    default = profiles.agg(F.min("p_type").alias("p_type"), F.lit(10).alias("least")).select(F.lit("*").alias("p_type"), "least")
    rows = tables.with_profile(p, profiles.unionByName(default), key="p_type", columns=["least"], default="*")
    v = tables.verdict([tables.Bound("price", F.lit(950.0), F.lit(1600.0)), tables.Bound("size", c("least") + 3)], [("preco", c("price").isNull()), ("tamanho", c("size").isNull())])
    return rows.select("p_partkey", v.alias("v")).select("p_partkey", c("v.verdict").alias("verdict"), F.array_join("v.reasons", ",").alias("reasons"))


VERDICT3 = """
WITH p AS (SELECT p_partkey, p_type, CASE WHEN p_size % 7 <> 0 THEN p_size END AS size, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS price FROM part),
f AS (SELECT p_type, min(p_size) AS least FROM part GROUP BY 1 HAVING p_type LIKE 'S%' OR p_type LIKE 'E%'),
r AS (SELECT p.*, coalesce(f.least, 10) AS least FROM p LEFT JOIN f USING (p_type))
SELECT p_partkey, CASE WHEN coalesce(price < 950 OR price > 1600, false) OR coalesce(size < least + 3, false) THEN 'REPROVADO' WHEN price IS NULL OR size IS NULL THEN 'INDETERMINADO' ELSE 'APROVADO' END AS verdict,
 CASE WHEN coalesce(price < 950 OR price > 1600, false) OR coalesce(size < least + 3, false) THEN '' ELSE concat_ws(',', CASE WHEN price IS NULL THEN 'preco' END, CASE WHEN size IS NULL THEN 'tamanho' END) END AS reasons
FROM r
"""


def fill_from_best(spark: SparkSession, folder: str) -> DataFrame:
    """Dwellings with unknown fields filled from the listing that was decided last (equi join, fill only what is missing)."""
    last = table(spark, folder, "imovel_anuncio").select("imovel_id", listing_key(c("url")).alias("key"), "decidido_em")
    best = tables.first_per_key(last, key=["imovel_id"], order=[c("decidido_em").desc(), c("key").asc()]).select("imovel_id", "key")
    rows = table(spark, folder, "imoveis").groupBy(listing_key(c("url")).alias("key")).agg(F.max("preco").alias("preco"), F.max("area_m2").alias("area_m2"))
    extra = best.join(rows, "key").select(c("imovel_id").alias("id"), "preco", "area_m2")
    return tables.filled(table(spark, folder, "imovel").select("id", "preco", "area_m2"), extra, key="id", columns=["preco", "area_m2"])


FILL = f"""
WITH l AS (SELECT * FROM (SELECT imovel_id, {KEY_SQL.format(u="url")} AS k, row_number() OVER (PARTITION BY imovel_id ORDER BY decidido_em DESC, {KEY_SQL.format(u="url")}) AS rn FROM imovel_anuncio) WHERE rn = 1),
r AS (SELECT {KEY_SQL.format(u="url")} AS k, max(preco) AS preco, max(area_m2) AS area_m2 FROM imoveis GROUP BY 1)
SELECT i.id, coalesce(i.preco, r.preco) AS preco, coalesce(i.area_m2, r.area_m2) AS area_m2 FROM imovel i LEFT JOIN l ON l.imovel_id = i.id LEFT JOIN r USING (k)
"""


#: Day from which a dwelling is new, and the least rooms wanted, in the queries below.
NEW_SINCE, ROOMS = "2026-05-01", 3


def _view(spark: SparkSession, folder: str) -> DataFrame:
    """The listing view over the dwellings, their listings, prices and conflicts: what the interactive query reads."""
    links = table(spark, folder, "imovel_anuncio").select(c("imovel_id").alias("id"), listing_key(c("url")).alias("key")).distinct()
    listings = _located(spark, folder).withColumn("key", listing_key(c("url")))
    offers = links.join(listings, "key").select("id", "url", "site", F.when(c("preco") > 0, c("preco")).alias("preco"), "fotos", "logradouro", "banheiros", "vagas", "andar")
    prices = table(spark, folder, "historico_precos").where("preco > 0").select(listing_key(c("url")).alias("key"), c("data").alias("day"), c("preco").alias("price"))
    allowed = table(spark, folder, "imovel").groupBy("cidade", "bairro").count().where("count >= 5 and not contains(lower(bairro), 'jardim')")
    conflicts = table(spark, folder, "conflito").select(c("imovel_id").alias("id"), "campo").distinct()
    rows = listing_view(table(spark, folder, "imovel").dropDuplicates(["id"]), offers, links.join(prices, "key"), allowed=allowed, new_since=NEW_SINCE, conflicts=conflicts)
    ids = table(spark, folder, "imovel").select("id")
    # Marks are kept by the reader's own tool; every tenth and seventeenth dwelling stands in for them.
    return marked(scored(materialize(rows, "view"), rooms=ROOMS), favourites=ids.where("id % 10 = 0"), discarded=ids.where("id % 17 = 0"))


_SCALED = "CASE WHEN {hi} > {lo} THEN 1 - greatest(0.0, least(1.0, ({x} - {lo}) / ({hi} - {lo}))) END"
_VIEW = f"""k AS (SELECT DISTINCT imovel_id AS id, {KEY_SQL.format(u="url")} AS k FROM imovel_anuncio),
li AS (SELECT *, {KEY_SQL.format(u="url")} AS k, CASE WHEN preco > 0 THEN preco END AS p FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ultima_confirmacao) AS rn FROM imoveis WHERE url IS NOT NULL) WHERE rn = 1),
o AS (SELECT id, min(p) AS pmin, max(p) AS pmax, count(DISTINCT site) AS f, count(*) AS anuncios, list_sort(list_distinct(list(site))) AS sites, arg_min(logradouro, {{'a': coalesce(p, 1e18), 'b': url}}) FILTER (WHERE logradouro IS NOT NULL) AS logradouro FROM k JOIN li USING (k) GROUP BY 1),
hd AS (SELECT id, data, min(preco) AS preco FROM k JOIN (SELECT {KEY_SQL.format(u="url")} AS k, data, preco FROM historico_precos WHERE preco > 0 AND data IS NOT NULL) USING (k) GROUP BY 1, 2),
hr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY data DESC) AS rn FROM hd),
al AS (SELECT DISTINCT trim(cidade) AS cidade, trim(regexp_replace(strip_accents(lower(bairro)), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM (SELECT cidade, bairro FROM imovel GROUP BY 1, 2 HAVING count(*) >= 5 AND NOT contains(lower(bairro), 'jardim'))),
b0 AS (SELECT i.id, coalesce(i.titulo, 'Apartamento') AS titulo, coalesce(i.bairro, '') AS bairro, coalesce(i.cidade, '') AS cidade, coalesce(o.logradouro, '') AS logradouro, coalesce(o.sites, []) AS sites, coalesce(o.pmin, nullif(i.custo_mensal_total, 0), i.preco) AS preco, i.area_m2, i.quartos,
 coalesce(date_diff('day', i.primeiro_visto, i.ultimo_visto), 0) AS dias, coalesce(i.custo_completo, false) AS custo_completo, greatest(coalesce(o.f, 1), 1) AS fontes, coalesce(o.anuncios, 0) AS anuncios, coalesce(round(o.pmax - o.pmin, 2), 0) AS economia,
 coalesce(i.primeiro_visto >= DATE '{NEW_SINCE}', false) AS novo, hr.preco AS antes, al.s IS NOT NULL AS no_recorte, i.id % 10 = 0 AS favorito, i.id % 17 = 0 AS descartado, coalesce(i.quartos >= {ROOMS}, false) AS atende
 FROM imovel i LEFT JOIN o ON o.id = i.id LEFT JOIN hr ON hr.id = i.id AND hr.rn = 2 LEFT JOIN al ON al.cidade = trim(i.cidade) AND al.s <> '' AND al.s = trim(regexp_replace(strip_accents(lower(i.bairro)), '[^a-z0-9]+', '-', 'g'), '-')),
b1 AS (SELECT *, CASE WHEN area_m2 > 0 THEN round(preco / area_m2, 2) END AS preco_m2, CASE WHEN antes > preco THEN round(antes - preco, 2) END AS queda FROM b0),
ex AS (SELECT min(preco) AS c0, max(preco) AS c1, min(preco_m2) AS m0, max(preco_m2) AS m1 FROM b1),
cr AS (SELECT b1.*, {_SCALED.format(x="preco", lo="c0", hi="c1")} AS s1, {_SCALED.format(x="preco_m2", lo="m0", hi="m1")} AS s2, CASE WHEN no_recorte THEN 1.0 ELSE 0.35 END::DOUBLE AS s3,
 CASE WHEN custo_completo THEN 0.6 ELSE 0.0 END::DOUBLE + CASE WHEN fontes > 1 THEN 0.4 ELSE 0.0 END::DOUBLE AS s4, CASE WHEN novo THEN 0.6 ELSE 0.0 END::DOUBLE + CASE WHEN queda > 0 THEN 0.4 ELSE 0.0 END::DOUBLE AS s5 FROM b1, ex),
sc AS (SELECT *, CAST(round_even(100 * (CASE WHEN preco IS NOT NULL THEN coalesce(s1, 0) * 1.0::DOUBLE ELSE 0 END + CASE WHEN preco_m2 IS NOT NULL THEN coalesce(s2, 0) * 0.8::DOUBLE ELSE 0 END + s3 * 1.0::DOUBLE + s4 * 0.5::DOUBLE + s5 * 0.3::DOUBLE)
 / (CASE WHEN preco IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN preco_m2 IS NOT NULL THEN 0.8::DOUBLE ELSE 0 END + 1.8::DOUBLE) * CASE WHEN atende THEN 1.0 ELSE 0.55 END::DOUBLE, 0) AS INT) AS score FROM cr),
tp AS (SELECT id FROM sc WHERE atende AND no_recorte AND score >= greatest(45, 1.25 * (SELECT avg(score) FROM sc)) ORDER BY score DESC, id LIMIT 3),
v AS (SELECT *, id IN (SELECT id FROM tp) AS melhor FROM sc)"""


def listing_view_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the listing view with their score."""
    return _view(spark, folder).select("id", "titulo", "bairro", "logradouro", "preco", "preco_m2", "dias", "fontes", "anuncios", "economia", "novo", "queda", "no_recorte", "score", "melhor", "atende", "favorito", F.array_join("sites", "|").alias("portais"))


VIEW_ROWS = f"""WITH {_VIEW} SELECT id, titulo, bairro, logradouro, preco, preco_m2, CAST(dias AS INT) AS dias, CAST(fontes AS INT) AS fontes, CAST(anuncios AS INT) AS anuncios, CAST(economia AS DOUBLE) AS economia, novo, queda, no_recorte, score, melhor, atende, favorito,
 array_to_string(sites, '|') AS portais FROM v"""


def _ranked(query: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        asked = ListingQuery.from_query_string(query)
        # The position in the order, as a value: the order itself is lost in a comparison of sets.
        rows = ranked(_view(spark, folder).where(asked.predicate()), asked.order())
        return rows.select("id", (c("rank") + 1).cast("int").alias("posicao"))

    run.__doc__ = f"The listing query {query!r} with each row's position."
    return run


def _ranked_sql(where: str, order: str) -> str:
    return f"WITH {_VIEW} SELECT id, CAST(row_number() OVER (ORDER BY {order}, id) AS INT) AS posicao FROM v WHERE NOT descartado AND {where}"


_RELEVANCE = "atende DESC, melhor DESC, score DESC, novo DESC, coalesce(queda, 0) > 0 DESC, coalesce(preco, 1e9)"


def market_pulse(spark: SparkSession, folder: str) -> DataFrame:
    """Aggregates over the default scope."""
    return pulse(_view(spark, folder).where(ListingQuery().predicate()))


PULSE = f"""WITH {_VIEW} SELECT count(*) AS total, count(*) FILTER (WHERE novo) AS novos, count(*) FILTER (WHERE queda > 0) AS quedas, count(*) FILTER (WHERE fontes > 1) AS multi,
 percentile_disc(0.5) WITHIN GROUP (ORDER BY preco_m2 DESC) AS mediana_m2, min(preco) AS preco_min, max(preco) AS preco_max FROM v WHERE NOT descartado AND no_recorte"""


def scopes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per scope."""
    return scope_counts(_view(spark, folder))


SCOPES = f"""WITH {_VIEW} SELECT count(*) FILTER (WHERE NOT descartado AND no_recorte) AS meus, count(*) FILTER (WHERE NOT descartado AND NOT no_recorte) AS outros,
 count(*) FILTER (WHERE NOT descartado AND favorito) AS favoritos, count(*) FILTER (WHERE descartado) AS lixeira FROM v"""


def facet_bairros(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbourhood values in the default scope."""
    return facet(_view(spark, folder), ListingQuery(), "bairro")


FACET = f"WITH {_VIEW} SELECT DISTINCT bairro FROM v WHERE NOT descartado AND no_recorte AND bairro <> ''"


def affinity_full(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers scored against each other, the best three marked."""
    s = table(spark, folder, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    out = tables.affinity(
        s,
        ranges={"custo": ("s_acctbal", 1.0, True)},
        flags={"regiao": (F.when(c("s_nationkey") < 8, 1.0).otherwise(0.35), 1.0), "momento": (F.when(c("s_suppkey") % 4 == 0, 0.6).otherwise(0.0), 0.3)},
        penalty=F.when(c("s_suppkey") % 5 == 0, 0.55).otherwise(1.0),
        eligible=c("s_suppkey") % 5 != 0,
        ties=["s_suppkey"],
    )
    return out.select("s_suppkey", "score", F.array_join("reasons", ",").alias("reasons"), "badge")


AFFINITY = """
WITH m AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier),
k AS (SELECT s_suppkey, 1 - greatest(0, least(1, (s_acctbal - lo) / (hi - lo))) AS custo, CASE WHEN s_nationkey < 8 THEN 1.0 ELSE 0.35 END::DOUBLE AS regiao, CASE WHEN s_suppkey % 4 = 0 THEN 0.6 ELSE 0.0 END::DOUBLE AS momento FROM supplier, m),
s AS (SELECT *, CAST(round_even(100 * (custo + regiao + momento * 0.3) / 2.3 * CASE WHEN s_suppkey % 5 = 0 THEN 0.55 ELSE 1.0 END::DOUBLE, 0) AS INT) AS score FROM k),
b AS (SELECT s_suppkey FROM s WHERE s_suppkey % 5 <> 0 AND score >= greatest(45, 1.25 * (SELECT avg(score) FROM s)) ORDER BY score DESC, s_suppkey LIMIT 3)
SELECT s_suppkey, score, concat_ws(',', CASE WHEN custo >= 0.7 THEN 'custo' END, CASE WHEN regiao >= 0.7 THEN 'regiao' END, CASE WHEN momento >= 0.7 THEN 'momento' END) AS reasons, s_suppkey IN (SELECT s_suppkey FROM b) AS badge FROM s
"""


FIELDS = ["preco", "area_m2", "quartos", "bairro", "cidade", "condominio_nome"]


def _offers(spark: SparkSession, folder: str) -> DataFrame:
    """The listings of each dwelling (the smallest one linked to it), numbered by the number in their address."""
    entity = table(spark, folder, "imovel_anuncio").groupBy(listing_key(c("url")).alias("key")).agg(F.min("imovel_id").alias("entity"))
    rows = _located(spark, folder).withColumn("key", listing_key(c("url")))
    return rows.join(entity, "key").withColumn("ord", F.regexp_extract("url", r"(\d{6})", 1).cast("bigint"))


def consolidate_field(spark: SparkSession, folder: str) -> DataFrame:
    """One value of each field of each dwelling over its listings, with the criterion that settled it; sources weigh by their trust."""
    written = {f: F.format_string("%.1f", c(f).cast("double")) if f in FIELDS[:3] else c(f) for f in FIELDS}
    values = _offers(spark, folder).select("entity", c("site").alias("source"), "ord", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.when(c(f).isNotNull(), v).alias("value")) for f, v in written.items()])).alias("x"))
    trust = table(spark, folder, "fonte").select(c("site").alias("source"), c("confianca").alias("trust"))
    out = resolution.consolidated(values.select("entity", "x.field", "x.value", "source", "ord"), numeric=FIELDS[:3], trust=trust)
    return out.select("entity", "field", F.coalesce("criterion", F.lit("")).alias("criterion"), "value")


_OFFERS_SQL = f"""y AS (SELECT {KEY_SQL.format(u="url")} AS k, min(imovel_id) AS entity FROM imovel_anuncio GROUP BY 1),
l AS (SELECT *, CAST(regexp_extract(url, '([0-9]{{6}})', 1) AS BIGINT) AS ord, {KEY_SQL.format(u="url")} AS k FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ultima_confirmacao) AS rn FROM imoveis WHERE url IS NOT NULL) WHERE rn = 1)"""

CONSOLIDATE = f"""
WITH {_OFFERS_SQL},
v AS (SELECT entity, ord, coalesce(f.confianca, 0.8) AS trust, unnest([{', '.join(f"{{'field': '{x}', 'value': {f'printf({chr(39)}%.1f{chr(39)}, CAST({x} AS DOUBLE))' if x in FIELDS[:3] else x}, 'amount': {f'round(CAST(printf({chr(39)}%.1f{chr(39)}, CAST({x} AS DOUBLE)) AS DOUBLE), 2)' if x in FIELDS[:3] else 'CAST(NULL AS DOUBLE)'}}}" for x in FIELDS)}]) AS x FROM l JOIN y USING (k) LEFT JOIN fonte f ON f.site = l.site),
g AS (SELECT entity, ord, trust, x.field AS field, x.value AS value, x.amount AS amount, coalesce(CAST(x.amount AS VARCHAR), x.value) AS same FROM v WHERE x.value IS NOT NULL AND x.value <> ''),
n AS (SELECT entity, field, same, count(*) AS n, arg_min(value, ord) AS value FROM g GROUP BY 1, 2, 3),
t AS (SELECT entity, field, max(n) AS top, count(*) AS d, arg_max(value, n) AS best FROM n GROUP BY 1, 2),
u AS (SELECT t.*, (SELECT count(*) FROM n WHERE n.entity = t.entity AND n.field = t.field AND n.n = t.top) AS ties FROM t),
m AS (SELECT entity, field, median(amount) AS med, arg_min(value, {{'a': -trust, 'b': ord}}) AS sure FROM g GROUP BY 1, 2)
SELECT entity, field, CASE WHEN d = 1 THEN '' WHEN top > 1 AND ties = 1 THEN 'maioria' WHEN med IS NOT NULL THEN 'mediana' ELSE 'fonte_mais_confiavel' END AS criterion,
 CASE WHEN d = 1 OR (top > 1 AND ties = 1) THEN best WHEN med IS NOT NULL THEN printf('%.2f', med) ELSE sure END AS value FROM u JOIN m USING (entity, field)
"""


def _located(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "imoveis").where("url is not null").dropDuplicates(["url"])


def block_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of listings that share a blocking key."""
    return resolution.blocked_listings(_located(spark, folder), id="url")


_ABBREVIATED = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in ABBREVIATIONS.items()) + "}"


def _words_sql(x: str) -> str:
    bare = f"regexp_replace(lower(strip_accents({x})), '[^a-z0-9\\s]', ' ', 'g')"
    return f"list_transform(list_filter(string_split_regex({bare}, '\\s+'), lambda w: w <> ''), lambda w: coalesce({_ABBREVIATED}[w], w))"


def _plain_sql(x: str) -> str:
    return f"CASE WHEN {x} <> '' THEN array_to_string({_words_sql(x)}, ' ') END"


def _said_sql(x: str) -> str:
    return f"CASE WHEN {x} <> '' THEN list_distinct({_words_sql(x)}) END"


_DIGITS = "nullif(regexp_replace(telefone, '[^0-9]', '', 'g'), '')"
_PHOTOS = """list_distinct(list_filter(list_transform(fotos, lambda u: coalesce(nullif(regexp_extract(u, '/([0-9a-f]{16,})[/.]', 1), ''),
 nullif(regexp_extract(lower(u), '/([^/?]+)\\.(?:jpe?g|webp|png)', 1), ''))), lambda u: u IS NOT NULL))"""


def _bands_sql(x: str, width: float) -> str:
    return f"CASE WHEN {x} > 0 THEN [CAST(floor(ln({x}) / {-math.log1p(-width)!r}) + d AS VARCHAR) FOR d IN [0, 1]] ELSE ['?'] END"


#: Listings, their blocking keys, and the pairs that share one: blocks of at most 60, larger ones cut by bands of cost, then of area.
_PAIRS_SQL = f"""i AS (SELECT *, coalesce(nullif(custo_mensal_total, 0), preco) AS custo, {_DIGITS} AS tel, coalesce({_PHOTOS}, []) AS fs,
 {_plain_sql("logradouro")} AS rua, {_plain_sql("bairro")} AS bai, {_plain_sql("condominio_nome")} AS pre, coalesce(CAST(quartos AS VARCHAR), '-1') AS q
 FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ultima_confirmacao) AS rn FROM imoveis WHERE url IS NOT NULL) WHERE rn = 1),
k0 AS (SELECT url, custo, area_m2, unnest(list_distinct(list_filter([
 'geo|' || round_even(latitude, 3) || '|' || round_even(longitude, 3) || '|' || q, 'rua|' || rua || '|' || coalesce(numero, ''), 'cond|' || pre || '|' || q,
 'fone|' || right(tel, 8) || '|' || q || '|' || CAST(CASE WHEN custo_mensal_total <> 0 THEN round_even(custo_mensal_total / 100, 0) END AS BIGINT)]
 || [CASE WHEN area_m2 <> 0 THEN 'bairro|' || bai || '|' || q || '|' || CAST(round_even(area_m2 / 5, 0) * 5 + d AS BIGINT) END FOR d IN [-5, 0, 5]]
 || ['foto|' || f FOR f IN fs], lambda x: x IS NOT NULL))) AS k FROM i),
s0 AS (SELECT k, count(*) AS n FROM k0 GROUP BY 1),
k1 AS (SELECT DISTINCT url, area_m2, k || '|c' || unnest({_bands_sql("custo", 0.15)}) AS k FROM k0 SEMI JOIN (SELECT k FROM s0 WHERE n > 60) USING (k)),
s1 AS (SELECT k, count(*) AS n FROM k1 GROUP BY 1),
k2 AS (SELECT DISTINCT url, k || '|a' || unnest({_bands_sql("area_m2", 0.12)}) AS k FROM k1 SEMI JOIN (SELECT k FROM s1 WHERE n > 60) USING (k)),
s2 AS (SELECT k, count(*) AS n FROM k2 GROUP BY 1),
h AS (SELECT url, k FROM k0 SEMI JOIN (SELECT k FROM s0 WHERE n BETWEEN 2 AND 60) USING (k) UNION ALL SELECT url, k FROM k1 SEMI JOIN (SELECT k FROM s1 WHERE n BETWEEN 2 AND 60) USING (k)
 UNION ALL SELECT url, k FROM k2 SEMI JOIN (SELECT k FROM s2 WHERE n BETWEEN 2 AND 60) USING (k)),
p AS (SELECT DISTINCT x.url AS a, y.url AS b FROM h x JOIN h y USING (k) WHERE x.url < y.url)"""

BLOCK_PAIRS = f"WITH {_PAIRS_SQL} SELECT a, b FROM p"


def _jaccard_sql(x: str) -> str:
    shared = f"len(list_intersect(x.{x}, y.{x}))"
    return f"{shared} / nullif(CAST(len(x.{x}) + len(y.{x}) - {shared} AS DOUBLE), 0)"


def _decay_sql(x: str, tolerance: float, limit: float) -> str:
    difference = f"abs(x.{x} - y.{x}) / greatest(x.{x}, y.{x})"
    return f"CASE WHEN x.{x} > 0 AND y.{x} > 0 THEN greatest(0.0, least(1.0, ({limit} - {difference}) / ({limit} - {tolerance}))) END"


_OVERLAP = {x: f"CASE WHEN x.{x} IS NOT NULL AND y.{x} IS NOT NULL THEN coalesce({_jaccard_sql(x)}, 0) END" for x in ("st", "ed", "ds", "ag")}
_ROOMS = [f"CASE WHEN x.{f} IS NOT NULL AND y.{f} IS NOT NULL THEN CAST(x.{f} = y.{f} AS INT) END" for f in ("quartos", "suites", "banheiros", "vagas")]
_SIGNALS = {
    "geo": "CASE WHEN m < 50 THEN 1.0 WHEN m < 150 THEN 0.7 WHEN m < 400 THEN 0.3 WHEN m IS NOT NULL THEN 0.0 END",
    "endereco": f"CASE WHEN x.st IS NULL OR y.st IS NULL THEN NULL WHEN x.numero <> '' AND y.numero <> '' THEN CASE WHEN x.numero = y.numero THEN least(1.0, {_OVERLAP['st']} + 0.3) ELSE {_OVERLAP['st']} * 0.5 END ELSE {_OVERLAP['st']} END",
    "area": _decay_sql("area_m2", 0.02, 0.12),
    "custo": _decay_sql("custo", 0.01, 0.15),
    "fotos": f"CASE WHEN len(x.fs) > 0 AND len(y.fs) > 0 THEN {_jaccard_sql('fs')} END",
    "comodos": f"list_avg([{', '.join(_ROOMS)}])",
    "condominio": _OVERLAP["ed"],
    "descricao": _OVERLAP["ds"],
    "contato": f"CASE WHEN x.tel IS NOT NULL AND y.tel IS NOT NULL THEN CAST(right(x.tel, 8) = right(y.tel, 8) AS INT) ELSE {_OVERLAP['ag']} END",
}
_WEIGHTS = MatchPolicy().weights
MATCH_PAIRS = f"""
WITH {_PAIRS_SQL},
r AS (SELECT *, {_said_sql("logradouro")} AS st, {_said_sql("condominio_nome")} AS ed, {_said_sql("imobiliaria")} AS ag, CASE WHEN length(descricao) >= 60 THEN {_said_sql("descricao")} END AS ds, {_plain_sql("cidade")} AS ci FROM i),
g AS (SELECT p.a, p.b, sqrt(pow((x.latitude - y.latitude) * 110540, 2) + pow((x.longitude - y.longitude) * 111320 * cos(radians(x.latitude)), 2)) AS m FROM p JOIN r x ON x.url = a JOIN r y ON y.url = b
 WHERE NOT coalesce(x.ci <> y.ci, false) AND NOT coalesce(abs(x.quartos - y.quartos) >= 2, false) AND NOT coalesce(x.site = y.site AND x.site <> '', false)
 AND NOT coalesce(x.area_m2 > 0 AND y.area_m2 > 0 AND abs(x.area_m2 - y.area_m2) / greatest(x.area_m2, y.area_m2) > 0.25, false)),
s AS (SELECT a, b, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in _SIGNALS.items())} FROM g JOIN r x ON x.url = a JOIN r y ON y.url = b),
t AS (SELECT *, ({' + '.join(f'coalesce({k} * {w}, 0)' for k, w in _WEIGHTS.items())}) / nullif({' + '.join(f'CASE WHEN {k} IS NOT NULL THEN {w} ELSE 0 END' for k, w in _WEIGHTS.items())}, 0) AS raw,
 {' + '.join(f'CAST({k} IS NOT NULL AS INT)' for k in _WEIGHTS)} AS n FROM s)
SELECT a, b, round(raw, 4) AS score, CASE WHEN raw >= 0.88 AND n >= 3 AND NOT coalesce(round(custo, 3) = 0, false) THEN 'MESMO_IMOVEL' WHEN raw >= 0.72 THEN 'PROVAVELMENTE_MESMO' ELSE 'PROVAVELMENTE_DIFERENTE' END AS class, n FROM t WHERE raw >= 0.55
"""


def match_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Blocked and scored pairs of listings, different ones left out."""
    rows = _located(spark, folder)
    pairs = resolution.blocked_listings(rows, id="url")
    scored = resolution.scored_pairs(pairs, rows, id="url")
    return scored.where("class <> 'DIFERENTE'").select("a", "b", "score", "class", "n")


def entity_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Constrained clusters of listings of the same dwelling."""
    rows = _located(spark, folder)
    pairs = resolution.blocked_listings(rows, id="url")
    scored = resolution.scored_pairs(pairs, rows, id="url")
    return resolution.clusters(scored, rows, id="url")


def gallery_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Listings to look for photos of, of the dwellings that have few: the cheapest two."""
    links = table(spark, folder, "imovel_anuncio").select(c("imovel_id").alias("id"), listing_key(c("url")).alias("key")).distinct()
    offers = links.join(_located(spark, folder).withColumn("key", listing_key(c("url"))), "key")
    own = offers.groupBy("id").agg(F.max_by("fotos", F.coalesce(F.size("fotos"), F.lit(0))).alias("fotos"))
    return bookkeeping.gallery_candidates(own, offers.withColumn("p", F.coalesce("preco", F.lit(1e18))), entity="id", photos="fotos", url="url", order=["p"])


CANDIDATES = f"""
WITH k AS (SELECT DISTINCT imovel_id AS id, {KEY_SQL.format(u="url")} AS k FROM imovel_anuncio),
l AS (SELECT *, {KEY_SQL.format(u="url")} AS k FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ultima_confirmacao) AS rn FROM imoveis WHERE url IS NOT NULL) WHERE rn = 1),
o AS (SELECT id, url, coalesce(preco, 1e18) AS p, max(coalesce(len(fotos), 0)) OVER (PARTITION BY id) AS n FROM k JOIN l USING (k)),
r AS (SELECT id, url, row_number() OVER (PARTITION BY id ORDER BY p, url) AS rn FROM o WHERE n < 5)
SELECT id, url FROM r WHERE rn <= 2
"""


def entity_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Dwellings of which any listing of the first source in the alphabet is marked."""
    links = table(spark, folder, "imovel_anuncio").select(c("imovel_id").alias("id"), listing_key(c("url")).alias("key")).distinct()
    marks = table(spark, folder, "imoveis").where("site = 'Achei Morada'").select(listing_key(c("url")).alias("key"))
    return bookkeeping.entity_marks(table(spark, folder, "imovel").select("id").distinct(), links, marks, entity="id", url="key")


ENTITY_MARKS = f"""
WITH m AS (SELECT DISTINCT {KEY_SQL.format(u="url")} AS k FROM imoveis WHERE site = 'Achei Morada')
SELECT DISTINCT id, id IN (SELECT imovel_id FROM imovel_anuncio WHERE {KEY_SQL.format(u="url")} IN (SELECT k FROM m)) AS marcado FROM imovel
"""


def workbook(spark: SparkSession, folder: str) -> DataFrame:
    """The dwellings as the workbook lists them."""
    costs = table(spark, folder, "imovel").dropDuplicates(["id"]).select("id", c("preco").alias("aluguel"), "condominio", "iptu", "custo_mensal_total", "primeiro_visto")
    return bookkeeping.workbook(_view(spark, folder).join(costs, "id")).select("ordem", "Novo?", "Fontes", "Título", "Bairro", "Custo completo?", "Visto 1ª vez em")


WORKBOOK = f"""WITH {_VIEW} SELECT row_number() OVER (ORDER BY v.novo DESC, coalesce(v.preco, 0), v.id) AS ordem, CASE WHEN v.novo THEN 'SIM' ELSE '' END AS "Novo?", array_to_string(v.sites, ', ') AS "Fontes", v.titulo AS "Título",
 CASE WHEN v.bairro = '' THEN 'Não Localizado' ELSE v.bairro END AS "Bairro", CASE WHEN v.custo_completo THEN 'SIM' ELSE 'NÃO' END AS "Custo completo?", coalesce(CAST(CAST(i.primeiro_visto AS DATE) AS VARCHAR), '') AS "Visto 1ª vez em" FROM v JOIN imovel i USING (id)"""


def card_badges(spark: SparkSession, folder: str) -> DataFrame:
    """The marks of each dwelling's card."""
    return badges(_view(spark, folder)).select("id", F.array_join("selos", "|").alias("selos"), F.array_join("contexto", "|").alias("contexto"))


BADGES = f"""WITH {_VIEW} SELECT id, array_to_string(list_filter([CASE WHEN queda > 0 THEN 'queda' END, CASE WHEN novo THEN 'novo' END, CASE WHEN melhor THEN 'melhor' END], lambda x: x IS NOT NULL)[1:2], '|') AS selos,
 array_to_string(list_filter([CASE WHEN fontes > 1 THEN 'multi' END, CASE WHEN dias > 60 THEN 'antigo' END], lambda x: x IS NOT NULL), '|') AS contexto FROM v"""


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """The dwellings of the linked listings: sources, spread of prices, days on the market."""
    batch = _offers(spark, folder)
    links, found, _ = entities_of(batch.drop("entity", "key", "ord"), batch.select(c("url").alias("id"), c("entity").cast("string").alias("cluster")))
    named = links.join(batch.select("url", "entity"), "url").groupBy("imovel_id").agg(F.min("entity").alias("entity"), F.count("*").alias("anuncios_n"))
    return found.join(named, "imovel_id").select("entity", "anuncios_n", "qtd_fontes", "custo_completo", "preco_min", "economia", "dias_anunciado", F.array_join("sites", "|").alias("portais"))


ENTITIES = f"""
WITH {_OFFERS_SQL}
SELECT entity, count(*) AS anuncios_n, CAST(count(DISTINCT site) + CASE WHEN bool_or(site IS NULL) THEN 1 ELSE 0 END AS INT) AS qtd_fontes, bool_or(custo_completo) AS custo_completo, min(preco) AS preco_min, round(max(preco) - min(preco), 2) AS economia,
 CAST(date_diff('day', min(primeiro_visto), max(ultimo_visto)) AS INT) AS dias_anunciado, coalesce(array_to_string(list_sort(list_distinct(list(site) FILTER (WHERE site IS NOT NULL))), '|'), '') AS portais FROM l JOIN y USING (k) GROUP BY 1
"""


def accepted_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Listings whose title names a dwelling, and whether they were seen within 30 days of a day."""
    rows = table(spark, folder, "imoveis").where("url is not null").groupBy("url").agg(F.max("titulo").alias("titulo"), F.max("ultimo_visto").alias("d"))
    room = F.when(F.pmod(F.length("url"), F.lit(9)) == 0, F.concat(F.lit("Sala  Comercial - "), "titulo")).otherwise(c("titulo"))
    return rows.select("url", is_dwelling(room).alias("moradia"), is_recent(c("d"), F.lit("2026-05-28").cast("date")).alias("recente"))


ACCEPTED = """
WITH r AS (SELECT url, max(titulo) AS t, max(ultimo_visto) AS d FROM imoveis WHERE url IS NOT NULL GROUP BY 1)
SELECT url, NOT coalesce(length(url) % 9 = 0 AND t IS NOT NULL OR regexp_matches(t, '(?i)(^|[^a-z])(galp[aã]o|terreno|consult[oó]rio|ponto\\s+comercial)([^a-z]|$)'), false) AS moradia, coalesce(date_diff('day', d, DATE '2026-05-28') <= 30, true) AS recente FROM r
"""


def marks_union(spark: SparkSession, folder: str) -> DataFrame:
    """Union of two mark tables over the customers; the local one wins."""
    cu = table(spark, folder, "customer")
    seed = cu.where("c_acctbal > 0").select("c_custkey", F.lit("semente").alias("v"))
    local = cu.where("c_nationkey < 12").select("c_custkey", F.lit("local").alias("v"))
    return tables.merged_marks(seed, local, key="c_custkey", value="v")


MARKS = "SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN 'local' ELSE 'semente' END AS v FROM customer WHERE c_acctbal > 0 OR c_nationkey < 12"


def best_photos(spark: SparkSession, folder: str) -> DataFrame:
    """The longest gallery among each dwelling's listings."""
    links = table(spark, folder, "imovel_anuncio").select("imovel_id", listing_key(c("url")).alias("key")).distinct()
    photos = tables.first_per_key(table(spark, folder, "imoveis").select(listing_key(c("url")).alias("key"), "fotos"), key=["key"], order=[c("fotos").asc_nulls_last()])
    keyed = links.join(photos, "key").withColumn("o", F.xxhash64("key"))
    return tables.best_gallery(keyed, entity="imovel_id", photos="fotos", order="o").select("imovel_id", F.size("fotos").alias("n"))


PHOTOS = f"""
WITH l AS (SELECT DISTINCT imovel_id, {KEY_SQL.format(u="url")} AS k FROM imovel_anuncio), p AS (SELECT {KEY_SQL.format(u="url")} AS k, max(len(fotos)) AS n FROM imoveis GROUP BY 1)
SELECT imovel_id, CAST(least(max(n), 12) AS INT) AS n FROM l JOIN p USING (k) WHERE n > 0 GROUP BY 1
"""


def visit_plan(spark: SparkSession, folder: str) -> DataFrame:
    """When each supplier's page would be visited, nations as domains with crawl delays."""
    s = table(spark, folder, "supplier")
    delays = s.select("s_nationkey", F.when(c("s_acctbal") > 9000, 45.0).when(c("s_acctbal") > 5000, 10.0).otherwise(-1.0).alias("delay"))
    return tables.visit_slots(s.select("s_suppkey", "s_nationkey"), domain="s_nationkey", order=["s_suppkey"], delays=delays).select("s_suppkey", "slot")


VISITS = """
WITH d AS (SELECT s_nationkey, least(max(delay), 30.0) AS d FROM (SELECT s_nationkey, CASE WHEN s_acctbal > 9000 THEN 45.0 WHEN s_acctbal > 5000 THEN 10.0 ELSE -1.0 END AS delay FROM supplier) WHERE delay > 0 GROUP BY 1)
SELECT s_suppkey, CAST((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) * coalesce(d, 0.0) AS DOUBLE) AS slot FROM supplier LEFT JOIN d USING (s_nationkey)
"""


def json_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each nation as a JSON document."""
    return json_rows(table(spark, folder, "nation").select("n_nationkey", "n_name"))


JSON_DOCS = """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS json FROM nation"""

QUERIES = {
    "verdict3": (verdict3, VERDICT3),
    "fill_from_best": (fill_from_best, FILL),
    "listing_view": (listing_view_rows, VIEW_ROWS),
    "card_badges": (card_badges, BADGES),
    "entities": (entities, ENTITIES),
    "accepted_titles": (accepted_titles, ACCEPTED),
    "gallery_candidates": (gallery_candidates, CANDIDATES),
    "entity_marks": (entity_marks, ENTITY_MARKS),
    "workbook": (workbook, WORKBOOK),
    "query_relevance": (_ranked(""), _ranked_sql("no_recorte", _RELEVANCE)),
    "query_price": (_ranked("ordem=preco&min=1500&quartos=2"), _ranked_sql("no_recorte AND preco >= 1500 AND quartos >= 2", "coalesce(preco, 1e9)")),
    "query_m2": (_ranked("ordem=m2&sinais=multi"), _ranked_sql("no_recorte AND fontes >= 2", "coalesce(preco_m2, 1e9)")),
    "query_area": (_ranked("ordem=area&q=Apto&escopo=outros"), _ranked_sql("NOT no_recorte AND lower(titulo || ' ' || bairro || ' ' || cidade || ' ' || logradouro || ' ' || array_to_string(sites, ' ')) LIKE '%apto%'", "coalesce(area_m2, 0) DESC")),
    "query_time": (_ranked("ordem=tempo&sinais=novos,quedas&escopo=favoritos"), _ranked_sql("favorito AND novo AND queda > 0", "coalesce(dias, 0)")),
    "market_pulse": (market_pulse, PULSE),
    "scope_counts": (scopes, SCOPES),
    "facet_bairros": (facet_bairros, FACET),
    "affinity_full": (affinity_full, AFFINITY),
    "consolidate_field": (consolidate_field, CONSOLIDATE),
    "block_pairs": (block_pairs, BLOCK_PAIRS),
    "match_pairs": (match_pairs, MATCH_PAIRS),
    "entity_clusters": (entity_clusters, None),
    "marks_union": (marks_union, MARKS),
    "best_photos": (best_photos, PHOTOS),
    "visit_plan": (visit_plan, VISITS),
    "json_documents": (json_documents, JSON_DOCS),
}
