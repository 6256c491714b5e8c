"""The view that the interactive listing query reads: one row per dwelling, with what its offers and price history add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.places import in_scope
from vitrine.functions.text import money_label
from vitrine.operators import changes, tables

#: What the score is made of: criterion -> weight.
WEIGHTS = {"custo": 1.0, "espaco": 0.8, "bairro": 1.0, "confianca": 0.5, "momento": 0.3}


def listing_view(entities: DataFrame, offers: DataFrame, history: DataFrame, *, allowed: DataFrame, new_since: str, conflicts: DataFrame | None = None) -> DataFrame:
    """The columns :class:`ListingQuery` needs, besides those a card shows; marks and score aside.

    ``entities``: ``id`` (unique), ``titulo, bairro, cidade, quartos, area_m2,
    preco, custo_mensal_total, custo_completo, primeiro_visto, ultimo_visto``;
    ``offers``: ``id, url, site, preco, fotos, logradouro, banheiros, vagas,
    andar``, one row per offer; ``history``: ``id, day, price``; ``allowed``:
    ``cidade, bairro`` shown; ``conflicts``: ``id, campo``. The price shown is
    the least of the offers, else the total or the dwelling's own; the drop is
    against the last daily minimum but one. Unknown numbers stay null, unknown
    texts become ''. An entity without offers or history keeps its row.
    """
    first = lambda x: F.min_by(x, F.struct(F.col(x).isNull(), F.coalesce("preco", F.lit(1e18)), "url"))
    of_offers = offers.where("id is not null").groupBy("id").agg(
        F.min("preco").alias("preco_min"), F.max("preco").alias("preco_max"), F.array_sort(F.collect_set("site")).alias("sites"), F.count_distinct("site").cast("int").alias("_fontes"),
        F.count("*").cast("int").alias("anuncios"), first("url").alias("url"), *[first(x).alias(x) for x in ("logradouro", "banheiros", "vagas", "andar")], F.max_by("fotos", F.size("fotos")).alias("fotos"),
    )
    rows = entities.join(of_offers, "id", "left").withColumnRenamed("preco", "_own")
    rows = rows.withColumn("preco", F.coalesce("preco_min", F.when(F.col("custo_mensal_total") != 0, F.col("custo_mensal_total")), "_own"))
    rows = changes.drops(changes.last_points(history, key=["id"], day="day", value="price"), rows, key=["id"], value="price", price="preco")
    if conflicts is not None:
        rows = rows.join(conflicts.groupBy("id").agg(F.array_sort(F.collect_set("campo")).alias("conflitos")), "id", "left")
    else:
        rows = rows.withColumn("conflitos", F.lit(None).cast("array<string>"))
    rows = in_scope(rows, allowed, city="cidade", place="bairro")
    none = F.array().cast("array<string>")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    area = F.when(F.col("area_m2") > 0, F.round(F.col("preco") / F.col("area_m2"), 2))
    return rows.select(
        "id", F.coalesce("titulo", F.lit("Apartamento")).alias("titulo"), text("bairro"), text("cidade"), text("logradouro"), F.coalesce("sites", none).alias("sites"), "preco", money_label(F.col("preco")).alias("preco_fmt"),
        area.alias("preco_m2"), "area_m2", "quartos", "banheiros", "vagas", "andar", F.coalesce(F.datediff("ultimo_visto", "primeiro_visto"), F.lit(0)).alias("dias"), F.coalesce("custo_completo", F.lit(False)).alias("custo_completo"),
        F.coalesce("conflitos", none).alias("conflitos"), F.greatest(F.coalesce("_fontes", F.lit(1)), F.lit(1)).alias("fontes"), F.coalesce("anuncios", F.lit(0)).alias("anuncios"), F.coalesce(F.round(F.col("preco_max") - F.col("preco_min"), 2), F.lit(0.0)).alias("economia"),
        F.coalesce("url", F.lit("#")).alias("url"), F.coalesce("fotos", none).alias("fotos"), F.coalesce(F.col("primeiro_visto") >= F.lit(new_since).cast("date"), F.lit(False)).alias("novo"), F.col("drop").alias("queda"), F.col("drop_pct").alias("queda_pct"), "no_recorte",
    )


def scored(view: DataFrame, *, rooms: int) -> DataFrame:
    """``view`` with ``score``, ``motivos``, ``melhor`` and ``atende``, each dwelling against the others of the list.

    Too few rooms, known or not, take it out of the choice and nearly halve the score.
    """
    enough: Column = F.coalesce(F.col("quartos") >= rooms, F.lit(False))
    ranges = {"custo": ("preco", WEIGHTS["custo"], True), "espaco": ("preco_m2", WEIGHTS["espaco"], True)}
    trust = F.when(F.col("custo_completo"), 0.6).otherwise(0.0) + F.when(F.col("fontes") > 1, 0.4).otherwise(0.0)
    moment = F.when(F.col("novo"), 0.6).otherwise(0.0) + F.when(F.col("queda") > 0, 0.4).otherwise(0.0)
    flags = {"bairro": (F.when(F.col("no_recorte"), 1.0).otherwise(0.35), WEIGHTS["bairro"]), "confianca": (trust, WEIGHTS["confianca"]), "momento": (moment, WEIGHTS["momento"])}
    rated = tables.affinity(view, ranges=ranges, flags=flags, penalty=F.when(enough, 1.0).otherwise(0.55), eligible=enough & F.col("no_recorte"), ties=["id"])
    return rated.withColumn("atende", enough).withColumnsRenamed({"reasons": "motivos", "badge": "melhor"})


def marked(view: DataFrame, *, favourites: DataFrame, discarded: DataFrame) -> DataFrame:
    """``view`` with ``favorito`` and ``descartado``, from tables of marked ids (``id``)."""
    for name, marks in (("favorito", favourites), ("descartado", discarded)):
        view = view.join(marks.select("id").distinct().withColumn(name, F.lit(True)), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return view
