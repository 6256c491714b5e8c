"""Sources by type: which function turns a source's pages into rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Type of a source that is listed but not read.
SKIPPED = "revisar"


def collected(sources: DataFrame, pages: DataFrame, readers: dict[str, Callable[[DataFrame], DataFrame]], *, site: str = "site", kind: str = "tipo") -> DataFrame:
    """The rows of all sources, each type read by its function and put under one another; columns a reader doesn't give are null.

    ``sources``: ``site, kind``; ``pages``: any columns with ``site``. Sources
    of the type ``SKIPPED`` are left out, a type without a reader is an error
    (one row is looked at).
    """
    named = sources.where(F.col(kind).isNotNull() & (F.col(kind) != SKIPPED)).select(site, kind).distinct()
    unknown = named.where(~F.col(kind).isin(*readers)).select(kind).first()
    if unknown:
        raise ValueError(f"no reader for sources of type {unknown[0]!r}")
    parts = [reader(pages.join(named.where(F.col(kind) == k).select(site), site, "left_semi")) for k, reader in readers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
