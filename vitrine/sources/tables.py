"""Reading the listing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``; columns and filters are pushed into the scan by Catalyst."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def conform(df: DataFrame, schema) -> DataFrame:
    """``df`` with exactly the columns of ``schema`` (additive evolution: absent columns become null)."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
