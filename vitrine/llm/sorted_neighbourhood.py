"""Multi-pass sorted neighbourhoods over a distributed total order, and whole blocks beside them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.arrow_groups import map_groups
from vitrine.operators.total_order import ranked

#: Ranks per block: what one comparison task holds.
BLOCK = 4096
#: Rows of one key up to which they are compared at once; more are split into pairs of blocks.
KEY_BLOCK = 512


#: Pairs compared at once.
PAIRS_AT_ONCE = 1 << 19

Compare = Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray]


def _alike_pairs(group: pa.Table, ids: np.ndarray, pairs: list[np.ndarray], compare: Compare) -> Iterator[pa.RecordBatch]:
    """The ids of the pairs of row positions that pass ``compare``."""
    i, j = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), dtype=np.int64)
    if len(i):
        ok = compare(group, i, j)
        a, b = ids[i[ok]], ids[j[ok]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def neighbours(rows: DataFrame, *, keys: list[str], id: str, fields: list[str], window: int, compare: Compare) -> DataFrame:
    """``(a, b)``, a < b: ids of the pairs that lie within ``window`` of each other in any pass and pass ``compare``.

    ``rows``: one row per record and pass, with the sort key in ``keys``;
    ``fields`` are what ``compare(table, i, j)`` needs to decide over pairs of
    row positions. The total order is cut into blocks of ``BLOCK`` ranks, each
    extended by the ``window`` rows before it, so every pair is compared in
    exactly one block and no block grows with the data.
    """
    ordered = ranked(rows.select(*keys, F.col(id).alias("id"), *fields), [*keys, "id"])
    block = (F.col("rank") / BLOCK).cast("bigint")
    into = F.when((F.col("rank") % BLOCK >= BLOCK - window), F.array(block, block + 1)).otherwise(F.array(block))
    spread = ordered.select("rank", "id", *fields, F.explode(into).alias("block"))

    def search(group: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = group.column("id").to_numpy()
        first = group.column("block")[0].as_py() * BLOCK
        ranks = group.column("rank").to_numpy()
        pairs = []
        for lag in range(1, window + 1):
            i = np.arange(0, len(ids) - lag)
            # The later row decides which block compares the pair.
            i = i[(ranks[i + lag] >= first) & (ids[i] != ids[i + lag])]
            pairs.append(np.stack([i, i + lag]))
        yield from _alike_pairs(group, ids, pairs, compare)

    return map_groups(spread, ["block"], ["rank"], search, "a bigint, b bigint").distinct()


def blocked(rows: DataFrame, *, key: str, id: str, fields: list[str], compare: Compare) -> DataFrame:
    """``(a, b)``, a < b: ids of all pairs of rows that share ``key`` and pass ``compare``, however far apart they sort.

    Keys must tell few records together. One with more than ``KEY_BLOCK`` rows
    is split into blocks and every pair of blocks is compared on its own, so no
    task grows with the data and no pair is lost.
    """
    keyed = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(id).alias("id"), *fields)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key", F.ceil(F.col("_n") / KEY_BLOCK).cast("int").alias("_n"))
    own = F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y")))
    spread = keyed.join(sizes, "key").withColumn("own", own).withColumn("o", F.explode(others))
    # Small keys share a bucket, so that comparing is worth its start.
    buckets = max(1, keyed.count() // BLOCK)
    cell = F.xxhash64("key", "o.x", "o.y")
    spread = spread.select("id", *fields, "own", "o.x", "o.y", cell.alias("cell"), F.pmod(cell, F.lit(buckets)).alias("bucket"))

    def search(group: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, own, cells = (group.column(c).to_numpy() for c in ("id", "own", "cell"))
        one = group.column("x").to_numpy() == group.column("y").to_numpy()
        pairs, held, lag = [], 0, 1
        while True:
            i = np.flatnonzero(cells[lag:] == cells[:-lag]) if lag < len(ids) else np.zeros(0, dtype=np.int64)
            if not len(i):
                break
            # Of two blocks only the pairs across.
            i = i[(ids[i] != ids[i + lag]) & (one[i] | (own[i] != own[i + lag]))]
            pairs.append(np.stack([i, i + lag]))
            held, lag = held + len(i), lag + 1
            if held > PAIRS_AT_ONCE:
                yield from _alike_pairs(group, ids, pairs, compare)
                pairs, held = [], 0
        yield from _alike_pairs(group, ids, pairs, compare)

    return map_groups(spread, ["bucket"], ["cell", "id"], search, "a bigint, b bigint").distinct()
