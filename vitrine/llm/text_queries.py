"""Queries of problems 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.languages import LANGUAGES, identified, to_correct
from vitrine.llm.leakage import leaked
from vitrine.sources.tables import table


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold all or a large part of a test item."""
    c = F.col
    found = leaked(table(spark, folder, "documents"), table(spark, folder, "avaliacao"), doc=c("doc_id"), text=c("text"), item=c("item_id"), item_text=c("text"))
    return found.select(c("doc").alias("doc_id"), c("item").alias("item_id"))


def _identified(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    return identified(table(spark, folder, "documents"), doc=c("doc_id"), text=c("text"), label=c("lang"), host=c("source"), address=c("url"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of the documents whose label is missing, wrong or one of several languages."""
    return to_correct(_identified(spark, folder)).select(F.col("doc").alias("doc_id"), F.col("language").alias("lang"))


def p10_stretches(spark: SparkSession, folder: str) -> DataFrame:
    """Language and confidence of every stretch of every document, in reading order."""
    code = F.get(F.array(*[F.lit(x) for x in LANGUAGES]), F.col("s.language"))
    each = _identified(spark, folder).select(F.col("doc").alias("doc_id"), F.posexplode("stretches").alias("ordem", "s"))
    return each.select("doc_id", "ordem", F.col("s.words").alias("palavras"), code.alias("lang"), F.round("s.confidence", 4).alias("confianca"))


QUERIES = {"p9_found": (p9_found, None), "p10_found": (p10_found, None), "p10_stretches": (p10_stretches, None)}
