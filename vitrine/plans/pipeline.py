"""One run over a batch of listings: upsert, events, resolution and entities, as lazy tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.similarity import MatchPolicy
from vitrine.operators import changes, resolution

NUMERIC = ["preco", "area_m2", "quartos", "suites", "banheiros", "vagas", "andar", "aluguel", "condominio", "iptu", "custo_mensal_total", "latitude", "longitude"]
TEXTS = ["bairro", "cidade", "logradouro", "numero", "cep", "condominio_nome", "descricao"]


@dataclass(frozen=True)
class RunResult:
    """The tables a run hands on; nothing is computed before one of them is written."""

    listings: DataFrame
    events: DataFrame
    links: DataFrame
    entities: DataFrame
    conflicts: DataFrame


def entities_of(batch: DataFrame, members: DataFrame, *, trust: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(links, entities, conflicts)`` of clustered listings (``members``: ``id, cluster``).

    An entity's id is the hash of its smallest listing address, so equal
    inputs give equal ids. ``qtd_fontes`` counts an unknown source as one.
    """
    link = members.select(F.xxhash64("cluster").alias("imovel_id"), F.col("id").alias("url"))
    sizes = link.groupBy("imovel_id").agg(F.count("*").alias("n"))
    links = link.join(sizes, "imovel_id").select("imovel_id", "url", F.when(F.col("n") == 1, 1.0).alias("score_match"), F.when(F.col("n") == 1, "UNICO").otherwise("MESMO_IMOVEL").alias("classificacao"))
    rows = link.join(batch, "url")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in (*NUMERIC, *TEXTS)])
    values = rows.select(F.col("imovel_id").alias("entity"), F.explode(fields).alias("x"), F.col("site").alias("source"), F.col("url").alias("ord"))
    settled = resolution.consolidated(values.select("entity", "x.field", "x.value", "source", F.xxhash64("ord").alias("ord")), numeric=NUMERIC, trust=trust)
    wide = settled.groupBy(F.col("entity").alias("imovel_id")).pivot("field", [*NUMERIC, *TEXTS]).agg(F.first("value"))
    wide = wide.select("imovel_id", *[F.col(f).cast("double").alias(f) for f in NUMERIC], *TEXTS)
    offers = F.sort_array(F.collect_list(F.struct(F.coalesce("preco", F.lit(1e18)).alias("ordem"), "site", "url", "preco", "area_m2", "quartos")))
    shape = rows.groupBy("imovel_id").agg(
        F.count_distinct("site").alias("_sites"),
        F.bool_or(F.col("site").isNull()).alias("_unknown"),
        F.array_sort(F.collect_set("site")).alias("sites"),
        F.bool_or("custo_completo").alias("custo_completo"),
        F.min("primeiro_visto").alias("primeiro_visto"),
        F.max("ultimo_visto").alias("ultimo_visto"),
        F.min("preco").alias("preco_min"),
        F.max("preco").alias("preco_max"),
        offers.alias("anuncios"),
    )
    entities = shape.join(wide, "imovel_id").withColumns(
        {
            "qtd_fontes": (F.col("_sites") + F.when(F.col("_unknown"), 1).otherwise(0)).cast("int"),
            "economia": F.round(F.col("preco_max") - F.col("preco_min"), 2),
            "preco_m2": F.round(F.try_divide("custo_mensal_total", "area_m2"), 2),
            "dias_anunciado": F.datediff("ultimo_visto", "primeiro_visto"),
        }
    )
    conflicts = settled.where("criterion is not null").select(F.col("entity").alias("imovel_id"), F.col("field").alias("campo"), F.col("offered").alias("valores"), F.col("value").alias("escolhido"), F.col("criterion").alias("criterio"))
    return links, entities.drop("_sites", "_unknown"), conflicts


def run(stored: DataFrame, batch: DataFrame, *, policy: MatchPolicy | None = None, trust: DataFrame | None = None) -> RunResult:
    """A run over ``batch`` (one row per ``url``) against the stored listings; an empty batch gives empty tables and keeps the stored ones."""
    overwrite = [c for c in ("site", "titulo", "bairro", "cidade", "preco", "quartos", "area_m2", "custo_completo") if c in batch.columns]
    keep = [c for c in batch.columns if c not in (*overwrite, "url")]
    listings = changes.upsert(stored, batch.withColumn("_o", F.lit(0)), key="url", order="_o", overwrite=overwrite, keep_known=keep)
    events = changes.listing_events(stored, batch, key="url", price="preco", texts={"descricao": "DESCRICAO_ALTERADA", "imobiliaria": "ANUNCIANTE_ALTERADO"}, status="status")
    pairs = resolution.blocked_listings(batch, id="url")
    scored = resolution.scored_pairs(pairs, batch, id="url", policy=policy)
    members = resolution.clusters(scored, batch, id="url", policy=policy)
    return RunResult(listings, events, *entities_of(batch, members, trust=trust))
