"""What changed between consecutive full snapshots (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.session import bounded_lookup

ADDED, REMOVED, CHANGED = "ADICIONADO", "REMOVIDO", "ALTERADO"


def delivered_runs(snapshots: DataFrame, runs: DataFrame, run_id: str, runs_id: str, runs_order: str) -> DataFrame:
    """``(run, seq)`` of the runs that delivered a snapshot, numbered from 1 by ``runs_order``.

    Runs unknown to ``runs`` or without a time are left out. The window has one
    partition but only one row per run.
    """
    delivered = snapshots.select(F.col(run_id).alias("run")).where("run is not null").distinct()
    known = runs.select(F.col(runs_id).alias("run"), F.col(runs_order).alias("at")).where("at is not null").groupBy("run").agg(F.min("at").alias("at"))
    return delivered.join(bounded_lookup(known), "run").select("run", F.row_number().over(Window.orderBy("at", "run")).alias("seq"))


def _differs(column: str, tolerance: float) -> Column:
    now, then = F.col(f"row.{column}"), F.col(f"prev.{column}")
    far = F.round(F.abs(now - then), 9) >= tolerance
    return F.when(now.isNull() & then.isNull(), F.lit(False)).when(now.isNull() | then.isNull(), F.lit(True)).otherwise(far)


def validity_intervals(
    snapshots: DataFrame, runs: DataFrame, *, key: Column, run_id: str, arrived: str, present: Column, texts: dict[str, Column], numbers: dict[str, Column], tolerance: float = 0.01
) -> DataFrame:
    """``(key, first, last)``: maximal runs of consecutive snapshots over which a record stood unchanged.

    Of several rows of one key in one snapshot, the greatest ``arrived`` speaks
    (ties: the greatest payload, so the result is deterministic; null is the
    smallest). ``texts`` are compared by hash, ``numbers`` (null-safe, NaN is
    null) beyond ``tolerance``. Rows with a null key are no record.

    Shuffles: one on (key, snapshot) behind a map-side maximum, so that a key
    with very many rows shrinks to one row per snapshot before it moves, and
    one on the key, which the island numbering and grouping share.
    """
    seqs = runs.select("run", "seq")
    payload = F.struct(
        F.col(arrived).alias("arrived"),
        F.coalesce(present, F.lit(False)).alias("present"),
        F.xxhash64(*texts.values(), *[F.isnull(c) for c in texts.values()]).alias("row_hash"),
        *[F.nanvl(c.cast("double"), F.lit(None).cast("double")).alias(n) for n, c in numbers.items()],
    )
    rows = snapshots.select(key.alias("key"), F.col(run_id).alias("run"), payload.alias("row")).where("key is not null")
    valid = rows.join(seqs, "run").groupBy("key", "seq").agg(F.max("row").alias("row")).where("row.present")
    order = Window.partitionBy("key").orderBy("seq")
    before = valid.withColumns({"prev": F.lag("row").over(order), "prev_seq": F.lag("seq").over(order)})
    changed = (F.col("row.row_hash") != F.col("prev.row_hash")).__or__(_any(_differs(n, tolerance) for n in numbers))
    starts = F.when((F.col("prev_seq") == F.col("seq") - 1) & ~changed, 0).otherwise(1)
    islands = before.select("key", "seq", starts.alias("starts")).withColumn("island", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("key", "island").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))


def _any(columns) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def change_events(intervals: DataFrame, runs: DataFrame) -> DataFrame:
    """``(run, key, change)`` from validity intervals: their starts, ends and adjacencies.

    An interval that starts right where the one before ends is a change; one
    that starts elsewhere an addition; one that ends before the last snapshot
    without a successor right behind a removal in the next snapshot. The first
    snapshot has no events.
    """
    order = Window.partitionBy("key").orderBy("first")
    framed = intervals.withColumns({"prev_last": F.lag("last").over(order), "next_first": F.lead("first").over(order)})
    opened = F.when(F.col("prev_last") == F.col("first") - 1, F.lit(CHANGED)).otherwise(F.lit(ADDED))
    ended = F.coalesce(F.col("next_first") > F.col("last") + 1, F.lit(True))
    events = F.array(
        F.when(F.col("first") > 1, F.struct(F.col("first").alias("seq"), opened.alias("change"))),
        F.when(ended, F.struct((F.col("last") + 1).alias("seq"), F.lit(REMOVED).alias("change"))),
    )
    found = framed.select("key", F.explode(F.array_compact(events)).alias("e")).select("key", "e.seq", "e.change")
    return found.join(runs, "seq").select("run", "key", "change")


def snapshot_changes(snapshots: DataFrame, runs: DataFrame, *, run_id: str, runs_id: str, runs_order: str, **how) -> DataFrame:
    """``(run, key, change)`` between consecutive delivered snapshots.

    ``how``: as in :func:`validity_intervals`. An empty table or a single
    snapshot gives no rows; other columns of the inputs are ignored.
    """
    seqs = bounded_lookup(delivered_runs(snapshots, runs, run_id, runs_id, runs_order))
    return change_events(validity_intervals(snapshots, seqs, run_id=run_id, **how), seqs)
