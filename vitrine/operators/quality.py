"""Source quality: yield, medians, demotion, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.total_order import ranked
from vitrine.session import bounded_lookup


def latest_runs(runs: DataFrame, *, run: str, n: int) -> DataFrame:
    """The ``n`` greatest run ids (a top-k: one row per kept run)."""
    return runs.select(run).where(F.col(run).isNotNull()).distinct().orderBy(F.desc(run)).limit(n)


def source_totals(stats: DataFrame, *, source: str, run: str, sums: list[str], failed: Column, skipped: Column, n: int = 10) -> DataFrame:
    """Per source over the last ``n`` runs: runs, sums and failures, skipped runs aside."""
    recent = stats.join(bounded_lookup(latest_runs(stats, run=run, n=n), n), run, "left_semi").where(~F.coalesce(skipped, F.lit(False)))
    return recent.groupBy(source).agg(F.count("*").alias("runs"), *[F.sum(s).alias(s) for s in sums], F.count_if(failed).alias("failures"))


def exclusive_entities(links: DataFrame, *, entity: str, source: str) -> DataFrame:
    """``(source, exclusive)``: entities that only this source offers. Least and greatest source stand in for a distinct count."""
    one = links.where(F.col(source).isNotNull()).groupBy(entity).agg(F.min(source).alias("_lo"), F.max(source).alias("_hi")).where("_lo = _hi")
    return one.groupBy(F.col("_lo").alias(source)).agg(F.count("*").alias("exclusive"))


def recent_median(counts: DataFrame, *, source: str, at: str, value: str, n: int = 5, healthy: Column | None = None) -> DataFrame:
    """Each row with ``median``: the median of the source's last ``n`` earlier positive values, of ``healthy`` rows only; null without history.

    Every row is kept, also those of no value. A running count of the rows that
    tell numbers them, so the last ``n`` of them are a range of that number,
    whatever lies between.
    """
    tells = F.coalesce((F.col(value) > 0) & (F.lit(True) if healthy is None else healthy), F.lit(False))
    marked = counts.withColumn("_tells", tells).withColumn("_at", F.sum(F.col("_tells").cast("int")).over(Window.partitionBy(source).orderBy(at)))
    by_number = Window.partitionBy(source).orderBy("_at")
    median = lambda w: F.expr(f"percentile(case when _tells then {value} end, 0.5)").over(w)
    before = F.when(F.col("_tells"), median(by_number.rangeBetween(-n, -1))).otherwise(median(by_number.rangeBetween(-n + 1, 0)))
    return marked.withColumn("median", before).drop("_tells", "_at")


def demoted(counts: DataFrame, *, value: str, share: float = 0.6, status: Column | None = None) -> DataFrame:
    """``status`` and ``reason`` of each row: PARCIAL for nothing at all ('zero') or less than ``share`` of ``median`` ('volume'), else OK.

    An earlier ``status`` other than OK stays, and without a median there is
    nothing to compare with.
    """
    given = F.lit("OK") if status is None else F.coalesce(status, F.lit("OK"))
    comparable = (given == "OK") & F.col("median").isNotNull()
    amount = F.coalesce(F.col(value), F.lit(0))
    reason = F.when(comparable & (amount == 0), "zero").when(comparable & (amount < share * F.col("median")), "volume")
    return counts.withColumns({"reason": reason, "status": F.when(reason.isNotNull(), "PARCIAL").otherwise(given)})


def source_yield(stats: DataFrame, active: DataFrame, exclusive: DataFrame, *, source: str, run: str, n: int = 10, failed: tuple[str, ...] = ("FALHA", "BLOQUEADO"), skipped: str = "PULADO") -> DataFrame:
    """``(source, runs, raw, useful, undetermined, seconds, failures, active, exclusive, status, seconds_per_useful, position)``: what each source costs and brings.

    ``stats``: one row per source and run with ``raw, useful, undetermined,
    seconds, status``; the last ``n`` runs count, skipped ones aside.
    ``active``, ``exclusive``: ``source, active`` and ``source, exclusive`` of
    the current stock. ``status`` is the one of the last run, null if the
    source took no part. The worst come first: least useful, least exclusive,
    most seconds.
    """
    sums = ["raw", "useful", "undetermined", "seconds"]
    totals = source_totals(stats, source=source, run=run, sums=sums, failed=F.col("status").isin(*failed), skipped=F.col("status") == skipped, n=n)
    last = stats.join(bounded_lookup(latest_runs(stats, run=run, n=1), 1), run, "left_semi").groupBy(source).agg(F.max("status").alias("status"))
    known = totals.join(active, source, "left").join(exclusive, source, "left").join(last, source, "left").na.fill(0, [*sums, "active", "exclusive"])
    rated = known.withColumn("seconds_per_useful", F.when(F.col("useful") > 0, F.round(F.col("seconds") / F.col("useful"), 1)))
    return ranked(rated, [F.col("useful").asc(), F.col("exclusive").asc(), F.col("seconds").desc(), F.col(source).asc()]).withColumn("position", (F.col("rank") + 1).cast("int")).drop("rank")


def shares_of_best(totals: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``<c>_share``: the value over the column's greatest (one row of maxima, read first)."""
    best = totals.agg(*[F.max(c).alias(c) for c in columns]).first()
    return totals.withColumns({f"{c}_share": F.try_divide(F.col(c), F.lit(best[c])) for c in columns})


def run_health(stats: DataFrame, *, run: str, status: str, source: str = "fonte", bad: tuple[str, ...] = ("FALHA", "BLOQUEADO", "PARCIAL")) -> DataFrame:
    """``(run, status, ok, degraded)`` per run: PARCIAL if any source is in a bad state."""
    per = stats.groupBy(run).agg(F.count_if(F.col(status) == "OK").alias("ok"), F.array_sort(F.collect_set(F.when(F.col(status).isin(*bad), F.col(source)))).alias("degraded"))
    return per.withColumn("status", F.when(F.size("degraded") > 0, "PARCIAL").otherwise("OK"))
