"""Positions in a total order over a distributed table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.session import materialize


def ranked(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    """``rows`` with ``rank``, the position from 0 in the total order by ``order``.

    Rows are range-partitioned and sorted, numbered within their partition, and
    the partition sizes (one number per partition) are added up on the driver.
    ``order`` must tell all rows apart, so that equal leading values can be
    split over partitions.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], names=[*b.schema.names, "part", "at"])
            at += n

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = materialize(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(number, schema), "ranked")
    sizes = {r["part"]: r["n"] for r in numbered.groupBy("part").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    starts = rows.sparkSession.createDataFrame(offsets, "part int, start bigint")
    return numbered.join(F.broadcast(starts), "part").select(*rows.columns, (F.col("start") + F.col("at")).alias("rank"))
