"""Run bookkeeping, galleries between listings and dwellings, marks of dwellings, cached robots verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.total_order import ranked

#: Photos below which a gallery is looked for, and listings of a dwelling that are tried.
FEW_PHOTOS, TRIED = 5, 2


def replaced(stored: DataFrame, batch: DataFrame, *, keys: list[str]) -> DataFrame:
    """``stored`` with the rows of ``batch`` in place of those of the same keys, and its new ones added; columns of ``stored``."""
    kept = stored.join(batch.select(*keys).distinct(), keys, "left_anti")
    return kept.select(*stored.columns).unionByName(batch.select(*stored.columns))


def opened(runs: DataFrame, *, run: int, at: str, version: str = "") -> DataFrame:
    """``runs`` (``id, iniciada_em, encerrada_em, status, versao_codigo``) with a run in progress; ``version``: the code's, '' if unknown."""
    fields = {f.name: f.dataType for f in runs.schema.fields}
    given = {"id": F.lit(run), "iniciada_em": F.lit(at), "status": F.lit("EM_ANDAMENTO"), "versao_codigo": F.lit(version)}
    row = runs.sparkSession.range(1).select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in fields.items()])
    return replaced(runs, row, keys=["id"])


def closed(runs: DataFrame, *, run: int, at: str, status: str) -> DataFrame:
    """``runs`` with the run's end and status."""
    this = F.col("id") == run
    return runs.withColumns({"encerrada_em": F.when(this, F.lit(at).cast(runs.schema["encerrada_em"].dataType)).otherwise(F.col("encerrada_em")), "status": F.when(this, F.lit(status)).otherwise(F.col("status"))})


def source_summary(stats: DataFrame, *, source: str, run: str, raw: str) -> DataFrame:
    """``stats`` with ``position`` within its run: the sources that delivered most first."""
    w = Window.partitionBy(run).orderBy(F.col(raw).desc_nulls_last(), F.col(source).asc())
    return stats.withColumn("position", F.row_number().over(w))


def yield_bars(rows: DataFrame, *, seconds: float = 20.0) -> DataFrame:
    """``rows`` of ``source_yield`` with the bars (percent of the best, at least 2), the seconds wasted by sources without anything useful, and a warning for those that took ``seconds`` or more."""
    best = rows.agg(F.max("useful"), F.max("exclusive"), F.sum(F.when(F.col("useful") == 0, F.col("seconds")).otherwise(0))).first()
    bar = lambda c, most: F.greatest(F.bround(100 * F.coalesce(F.col(c), F.lit(0)) / F.lit(float(most or 1))).cast("int"), F.lit(2))
    return rows.withColumns({"useful_bar": bar("useful", best[0]), "exclusive_bar": bar("exclusive", best[1]), "wasted": F.lit(float(best[2] or 0)), "warning": (F.col("useful") == 0) & (F.col("seconds") >= seconds)})


def gallery_candidates(entities: DataFrame, offers: DataFrame, *, entity: str, photos: str, url: str, order: list[str]) -> DataFrame:
    """``(entity, url)``: up to ``TRIED`` listings of each dwelling with fewer than ``FEW_PHOTOS`` photos, whose pages are worth a visit."""
    few = entities.where(F.coalesce(F.size(photos), F.lit(0)) < FEW_PHOTOS).select(entity)
    first = Window.partitionBy(entity).orderBy(*order, url)
    return offers.join(few, entity, "left_semi").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= TRIED).select(entity, url)


def grown_galleries(entities: DataFrame, offers: DataFrame, found: DataFrame, *, entity: str, photos: str, url: str) -> DataFrame:
    """``entities`` with the longest gallery found for one of their listings, where it is longer than their own; ties: the least address.

    ``found``: ``url`` and ``photos``, one row per visited page.
    """
    longest = F.max_by(photos, F.struct(F.size(photos), (-F.xxhash64(url)).alias("o")))
    best = offers.select(entity, url).join(found.where(F.size(photos) > 0).select(url, photos), url).groupBy(entity).agg(longest.alias("_new"))
    longer = F.size("_new") > F.coalesce(F.size(photos), F.lit(0))
    return entities.join(best, entity, "left").withColumn(photos, F.when(longer, F.col("_new")).otherwise(F.col(photos))).select(*entities.columns)


def entity_marks(entities: DataFrame, offers: DataFrame, marks: DataFrame, *, entity: str, url: str) -> DataFrame:
    """``entities`` with ``marcado``: whether any of their listings is marked."""
    hit = offers.select(entity, url).join(marks.select(url).where(F.col(url).isNotNull()).distinct(), url, "left_semi").select(entity).distinct().withColumn("_hit", F.lit(True))
    return entities.join(hit, entity, "left").withColumn("marcado", F.coalesce("_hit", F.lit(False))).drop("_hit")


def due_hosts(hosts: DataFrame, cache: DataFrame, *, host: str, at: str, today: str, days: int = 30) -> DataFrame:
    """The hosts whose robots verdict isn't cached or is older than ``days``; ``cache``: ``host, at``, the latest counts."""
    known = cache.groupBy(host).agg(F.max(at).alias("_at"))
    fresh = F.coalesce(F.datediff(F.lit(today).cast("date"), F.to_date("_at")) <= days, F.lit(False))
    return hosts.select(host).distinct().join(known, host, "left").where(~fresh).select(host)


def workbook(view: DataFrame) -> DataFrame:
    """The 19 columns of the workbook in order of its rows (``ordem``): new dwellings first, then by price; what is unknown says so.

    ``view``: a listing view with ``aluguel, condominio, iptu,
    custo_mensal_total, primeiro_visto`` besides.
    """
    from vitrine.functions.text import or_missing

    yes = lambda c, no="": F.when(F.coalesce(F.col(c), F.lit(False)), "SIM").otherwise(no)
    placed = ranked(view, [F.col("novo").desc(), F.coalesce(F.col("preco"), F.lit(0)).asc(), F.col("id").asc()])
    return placed.select(
        (F.col("rank") + 1).alias("ordem"), yes("novo").alias("Novo?"), F.array_join("sites", ", ").alias("Fontes"), F.col("fontes").alias("Nº fontes"), F.col("titulo").alias("Título"), or_missing(F.col("logradouro")).alias("Endereço"), or_missing(F.col("bairro")).alias("Bairro"),
        or_missing(F.col("aluguel")).alias("Aluguel"), or_missing(F.col("condominio")).alias("Condomínio"), or_missing(F.col("iptu")).alias("IPTU"), or_missing(F.coalesce(F.nullif(F.col("custo_mensal_total"), F.lit(0.0)), F.col("preco"))).alias("Custo total"),
        yes("custo_completo", "NÃO").alias("Custo completo?"), or_missing(F.col("preco_m2")).alias("R$/m²"), or_missing(F.col("quartos")).alias("Quartos"), or_missing(F.col("banheiros")).alias("Banheiros"), or_missing(F.col("andar")).alias("Andar"), or_missing(F.col("area_m2")).alias("Área (m²)"),
        or_missing(F.col("dias")).alias("Dias no mercado"), F.coalesce(F.col("primeiro_visto").cast("string"), F.lit("")).alias("Visto 1ª vez em"), F.when(F.col("url") == "#", "").otherwise(F.col("url")).alias("Link"),
    )
