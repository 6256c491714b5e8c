"""Queries of problems 4, 6 and 8 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.urls import listing_key
from vitrine.llm.components import connected_components, star_edges
from vitrine.llm.packing import pack
from vitrine.llm.survivorship import latest_offers, plain_text, surviving_values, two_decimals, usable_value
from vitrine.llm.tokens import TOKENIZER, token_counts
from vitrine.queries.core_problems import KEY_SQL, listing_names
from vitrine.session import bounded_lookup, materialize
from vitrine.sources.tables import table

TEXT_FIELDS = ["bairro"]
#: Classes of a decision that link a dwelling and a listing.
LINKING = ["UNICO", "MESMO_IMOVEL", "PROVAVELMENTE_MESMO"]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Disputed fields whose stored value is wrong, with the surviving value."""
    latest = latest_offers(table(spark, folder, "conflito"), group="imovel_id", field="campo", values="valores", chosen="escolhido", at="detectado_em")
    trust = table(spark, folder, "fonte").groupBy(plain_text(F.col("site")).alias("source")).agg(F.max("confianca").alias("trust"))
    survivors = surviving_values(latest, bounded_lookup(trust), TEXT_FIELDS).where("value is not null")
    stored = latest.select("group_id", "field", usable_value(F.col("field"), F.col("chosen"), TEXT_FIELDS).alias("stored"))
    totals = table(spark, folder, "imovel").where("id is not null").groupBy(F.col("id").alias("group_id")).agg(F.max("custo_mensal_total").alias("total"))
    both = survivors.join(stored, ["group_id", "field"]).join(totals, "group_id", "left")
    total = two_decimals(F.nullif(F.round(F.nanvl("total", F.lit(0.0)), 2), F.lit(0.0)))
    wrong = ~F.col("value").eqNullSafe(F.col("stored")) | ((F.col("field") == "custo_mensal_total") & ~F.col("value").eqNullSafe(total))
    return both.where(wrong).select(F.col("group_id").alias("imovel_id"), F.col("field").alias("campo"), F.col("value").alias("valor"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every listing with a standing link and the smallest dwelling id of its group."""
    kind = F.upper(F.regexp_replace(plain_text(F.col("classificacao")), r"[\s_-]+", "_"))
    rows = table(spark, folder, "imovel_anuncio").select("imovel_id", listing_key(F.col("url")).alias("key"), F.struct(F.col("decidido_em").alias("at"), kind.alias("kind")).alias("d"))
    standing = rows.where("imovel_id is not null and key is not null").groupBy("imovel_id", "key").agg(F.max("d").alias("d"))
    links = materialize(standing.where(F.col("d.kind").isin(LINKING)).select("imovel_id", "key"), "links")
    edges = star_edges(links, hub="key", member="imovel_id")
    labels = connected_components(edges, links.select(F.col("imovel_id").alias("v")))
    by_key = links.groupBy("key").agg(F.min("imovel_id").alias("v"))
    named = by_key.join(labels, "v").select("key", F.col("label").alias("grupo"))
    return named.join(listing_names(spark, folder), "key").select("url", "grupo")


def p8_packed(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """All document texts packed into containers of each size of ``janela``."""
    sizes = materialize(token_counts(table(spark, folder, "documents"), id=F.col("doc_id"), text=F.col("text"), tokenizer=tokenizer), "sizes")
    packed = pack(sizes, table(spark, folder, "janela").select(F.col("janela_id").alias("container"), F.col("capacidade_tokens").alias("capacity")))
    return packed.select(F.col("container").alias("janela_id"), F.col("cell").alias("lote"), F.col("bin").alias("conteiner"), F.col("id").alias("doc_id"), F.col("piece").alias("pedaco"), F.col("start").alias("inicio"), F.col("size").alias("n_tokens"))


_PLAIN = "trim(regexp_replace(strip_accents(lower({})), '\\s+', ' ', 'g'))"
_AMOUNT = """nullif(round(TRY_CAST(CASE WHEN d LIKE '%,%' THEN replace(replace(d, '.', ''), ',', '.')
 WHEN regexp_full_match(d, '[0-9]{1,3}([.][0-9]{3})+') THEN replace(d, '.', '') ELSE d END AS DOUBLE), 2), 0)"""


def _value_sql(field: str, text: str) -> str:
    d = f"nullif(regexp_replace(regexp_extract({text}, '([0-9][0-9.,]*)', 1), '[.,]+$', ''), '')"
    p = _PLAIN.format(text)
    none = "'', '-', 'n/d', 'null', 'nao informado', 'sob consulta', 'consulte'"
    amount = _AMOUNT.replace(" d ", f" {d} ").replace("(d,", f"({d},")
    return f"CASE WHEN {field} = 'bairro' THEN CASE WHEN {p} IN ({none}) OR regexp_full_match({p}, '[0.,]+') THEN NULL ELSE {p} END ELSE printf('%.2f', {amount}) END"


P4_SQL = f"""
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY imovel_id, campo ORDER BY detectado_em DESC) AS rn FROM conflito) WHERE rn = 1),
e AS (SELECT imovel_id, campo, unnest(map_entries(valores)) AS e FROM l),
v AS (SELECT imovel_id, campo, {_PLAIN.format("e.key")} AS src, {_value_sql("campo", "e.value")} AS val FROM e),
g AS (SELECT v.imovel_id, v.campo, val, count(DISTINCT src) AS n, max(coalesce(confianca, 0)) AS c
      FROM v LEFT JOIN fonte f ON {_PLAIN.format("f.site")} = v.src WHERE val IS NOT NULL GROUP BY 1, 2, 3),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY imovel_id, campo ORDER BY n DESC, c DESC, val DESC) AS rn FROM g) WHERE rn = 1)
SELECT b.imovel_id, b.campo, b.val AS valor FROM b JOIN l USING (imovel_id, campo) LEFT JOIN imovel i ON i.id = b.imovel_id
WHERE b.val IS DISTINCT FROM ({_value_sql("l.campo", "l.escolhido")})
   OR (b.campo = 'custo_mensal_total' AND b.val IS DISTINCT FROM printf('%.2f', nullif(round(i.custo_mensal_total, 2), 0)))
"""

P6_SQL = f"""
WITH RECURSIVE a AS (SELECT imovel_id AS i, {KEY_SQL.format(u="url")} AS k, decidido_em, upper(regexp_replace(trim(classificacao), '[ _]+', '_', 'g')) AS c FROM imovel_anuncio),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i, k ORDER BY decidido_em DESC, c DESC) AS rn FROM a) WHERE rn = 1 AND c IN ('UNICO', 'MESMO_IMOVEL', 'PROVAVELMENTE_MESMO')),
e AS (SELECT DISTINCT x.i AS p, y.i AS q FROM s x JOIN s y USING (k)),
r AS (SELECT p AS v, p AS root FROM e UNION SELECT e.q, r.root FROM r JOIN e ON e.p = r.v),
g AS (SELECT v, min(root) AS grupo FROM r GROUP BY 1),
n AS (SELECT {KEY_SQL.format(u="url")} AS k, min(url) AS url FROM imoveis GROUP BY 1)
SELECT n.url, min(g.grupo) AS grupo FROM s JOIN g ON g.v = s.i JOIN n USING (k) GROUP BY 1
"""

QUERIES = {"p4_found": (p4_found, P4_SQL), "p6_found": (p6_found, P6_SQL), "p8_packed": (p8_packed, None)}
