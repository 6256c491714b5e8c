"""History of a changing attribute: coalescing unit intervals by tree reduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def observations(rows: DataFrame, *, entity: Column, day: Column, value: Column, recorded: Column) -> DataFrame:
    """``(entity, day, value)``: the latest recorded usable value of each day.

    Null, NaN and non-positive values are no observation; rows without entity
    or day are none either. Ties in ``recorded``: the greatest value. The
    maximum combines before the shuffle, so an entity with very many rows
    moves at most one row per day and map task.
    """
    usable = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    picked = rows.select(entity.alias("entity"), day.alias("day"), recorded.alias("at"), usable.alias("value"))
    picked = picked.where("entity is not null and day is not null and value > 0")
    return picked.groupBy("entity", "day").agg(F.max(F.struct("at", "value")).alias("o")).select("entity", "day", "o.value")


def _coalesce(left: Column, right: Column, tolerance: float) -> Column:
    """Two neighbouring lists of runs as one; the runs at the seam merge if their values agree."""
    end, start = F.element_at(left, -1), F.element_at(right, 1)
    same = F.round(F.abs(end["closing"] - start["opening"]), 9) < tolerance
    seam = F.struct(end["first"].alias("first"), start["last"].alias("last"), end["opening"].alias("opening"), start["closing"].alias("closing"))
    merged = F.concat(F.slice(left, 1, F.size(left) - 1), F.array(seam), F.slice(right, 2, F.greatest(F.size(right) - 1, F.lit(0))))
    return F.when(left.isNull(), right).when(right.isNull(), left).when(same, merged).otherwise(F.concat(left, right))


def coalesce_runs(units: DataFrame, longest: int, tolerance: float = 0.01) -> DataFrame:
    """``(entity, runs)``: per entity the ordered runs of consecutive observations with one value.

    ``units`` has ``entity, position, day, value``, positions 0, 1, ... per
    entity in order of days, all below ``longest``. Each observation is a unit interval. In every
    round the blocks 2b and 2b+1 of an entity merge; their runs join at the
    seam only, so a round costs what is left of the runs, and there are
    ceil(log2(longest)) rounds. All rounds group by entity and block,
    which the partitioning by entity already serves: none of them shuffles.
    """
    run = F.array(F.struct(F.col("day").alias("first"), F.col("day").alias("last"), F.col("value").alias("opening"), F.col("value").alias("closing")))
    blocks = units.select("entity", F.col("position").cast("int").alias("block"), run.alias("runs"))
    for _ in range(max(longest - 1, 0).bit_length()):
        even = F.col("block") % 2 == 0
        halves = blocks.groupBy("entity", F.expr("block div 2").cast("int").alias("pair")).agg(F.max(F.when(even, F.col("runs"))).alias("a"), F.max(F.when(~even, F.col("runs"))).alias("b"))
        blocks = halves.select("entity", F.col("pair").alias("block"), _coalesce(F.col("a"), F.col("b"), tolerance).alias("runs"))
    return blocks.select("entity", "runs")


def versions(seen: DataFrame, bounds: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """``(entity, ..., valid_from, valid_to, value)``: one row per version.

    ``seen``: as :func:`observations` gives it. ``bounds``: ``entity, since,
    until`` and further columns, one row per entity; observations outside
    ``since``..``until`` (both included) don't count. The last version ends on
    ``until``, each other the day before the next starts. Entities missing on
    either side have no versions. The number of rounds follows from the
    longest span of days, read from ``bounds`` alone.
    """
    span = bounds.agg(F.max(F.datediff("until", "since"))).first()[0]
    inside = seen.join(bounds.select("entity", "since", "until"), "entity").where("day between since and until")
    units = inside.select("entity", "day", "value", (F.row_number().over(Window.partitionBy("entity").orderBy("day")) - 1).alias("position"))
    runs = coalesce_runs(units, (span or 0) + 1, tolerance).join(bounds, "entity")
    following = F.transform("runs", lambda r, i: F.struct(r["first"].alias("first"), r["opening"].alias("value"), F.get(F.col("runs"), i + 1)["first"].alias("next")))
    each = runs.select(*bounds.columns, F.explode(following).alias("r"))
    return each.select(*bounds.columns, F.col("r.first").alias("valid_from"), F.coalesce(F.date_sub("r.next", 1), F.col("until")).alias("valid_to"), F.col("r.value").alias("value"))
