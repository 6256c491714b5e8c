"""Running a function over groups that are sorted streams of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def map_groups(df: DataFrame, keys: list[str], order: list[str], function: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``function`` to each group of ``keys``, its rows in ``order``.

    One shuffle by the keys and one sort; the groups of a partition are cut out
    of the Arrow stream, so small groups cost little and only the group at hand
    is held in memory. Callers bound the group size. ``function`` may yield any
    number of batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            columns = [table.column(k).combine_chunks() for k in keys]
            change = np.zeros(table.num_rows, dtype=bool)
            for c in columns:
                codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            first = tuple(c[0].as_py() for c in columns)
            if last is not None and first != last:
                yield from function(pa.concat_tables(held))
                held = []
            cuts = [0, *np.flatnonzero(change).tolist(), table.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:-1], strict=False):
                yield from function(pa.concat_tables([*held, table.slice(a, b - a)]))
                held = []
            held.append(table.slice(cuts[-2], cuts[-1] - cuts[-2]))
            last = tuple(c[-1].as_py() for c in columns)
        if held:
            yield from function(pa.concat_tables(held))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
