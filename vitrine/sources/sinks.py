"""Writing results: Parquet snapshots per run, ordered CSV, one JSON document per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def workbook_rows(rows: DataFrame, *, new: str, price: str, id: str) -> DataFrame:
    """The rows of the workbook: new ones first, then by price, unknown prices first."""
    return rows.orderBy(F.col(new).desc(), F.coalesce(F.col(price), F.lit(0)).asc(), F.col(id).asc())


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV folder with a header; the order of ``rows`` is kept within and across files."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def json_rows(rows: DataFrame) -> DataFrame:
    """``json``: each row as a JSON object that is safe inside a script element."""
    return rows.select(F.replace(F.to_json(F.struct(*rows.columns)), F.lit("</"), F.lit("<\\/")).alias("json"))


def write_snapshot(rows: DataFrame, folder: str, run: int) -> str:
    """Writes a run's snapshot to its own folder, so that nothing is read and overwritten at once; returns the path."""
    path = f"{folder.rstrip('/')}/run={run}"
    rows.write.mode("overwrite").parquet(path)
    return path


def read_marks(spark, path: str) -> DataFrame:
    """``(url, data)`` of a JSON file that maps addresses to dates or lists addresses; a missing or unreadable file gives no rows.

    The file is one user's marks, so it is read on the driver.
    """
    import json
    from pathlib import Path

    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        found = {}
    pairs = [(str(k), str(v)) for k, v in found.items()] if isinstance(found, dict) else [(str(k), "") for k in found] if isinstance(found, list) else []
    return spark.createDataFrame(pairs, "url string, data string")


def search_url(template: str, *, least: float, most: float) -> str:
    """A search address with its price bounds filled in; a least price of 0 takes its parameter away."""
    import re

    if not least:
        template = re.sub(r"([?&])[^?&=]+=\{preco_min\}(&?)", lambda m: m[1] if m[2] else "", template)
    return template.replace("{preco_min}", f"{least:g}").replace("{preco_max}", f"{most:g}")
