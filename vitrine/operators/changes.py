"""Change logs, price series, upserts, lifecycles and retention."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change_log(rows: DataFrame, *, key: list[str], order: list[str], value: str, tolerance: float = 0.01) -> DataFrame:
    """``rows`` that start a key or differ from the value emitted before by ``tolerance`` or more.

    Adds ``kind`` (CRIADO, PRECO_ALTERADO), ``before``, ``delta``, ``delta_pct``
    (both rounded to 2; null for the first and for a zero before). Null values
    are left out. The comparison is with the last emitted value, so slow drift
    is caught. Rows equal to the one before never matter and are dropped in the
    window that orders the key; the rest is folded in that order as a stream,
    with one value of state, so a key with very many rows is never held whole.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    ordered = rows.where(F.col(value).isNotNull()).select(*key, *order, F.col(value).cast("double").alias(value)).withColumn("before", F.lag(value).over(w))
    moved = ordered.where(F.col("before").isNull() | (F.col("before") != F.col(value)))
    width, at = len(key), len(key) + len(order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, None
        for b in batches:
            keys = list(zip(*[col.to_pylist() for col in b.columns[:width]], strict=True))
            keep, befores = [], []
            for k, v in zip(keys, b.column(at).to_pylist(), strict=True):
                if k != current:
                    current, last = k, None
                emit = last is None or round(abs(v - last), 9) >= tolerance
                keep.append(emit)
                befores.append(last if emit else None)
                last = v if emit else last
            columns = [*b.columns[: at + 1], pa.array(befores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema).filter(pa.array(keep))

    emitted = moved.mapInArrow(fold, moved.schema)
    return event_deltas(emitted, "before", value).withColumn("kind", F.when(F.col("before").isNull(), "CRIADO").otherwise("PRECO_ALTERADO"))


def event_deltas(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Adds ``delta`` and ``delta_pct`` of two numbers, rounded to 2; null without both or for a zero before."""
    x, y = F.col(before), F.col(after)
    both = x.isNotNull() & y.isNotNull() & (x != 0)
    return rows.withColumns({"delta": F.when(both, F.round(y - x, 2)), "delta_pct": F.when(both, F.round(100 * (y - x) / x, 2))})


def last_points(rows: DataFrame, *, key: list[str], day: str, value: str, n: int = 30) -> DataFrame:
    """The least value of each day, of the last ``n`` days of each key; ``rank`` 1 is the latest."""
    daily = rows.where(F.col(value).isNotNull() & F.col(day).isNotNull()).groupBy(*key, day).agg(F.min(value).alias(value))
    return daily.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(day)))).where(F.col("rank") <= n)


def drops(points: DataFrame, shown: DataFrame, *, key: list[str], value: str, price: str) -> DataFrame:
    """``shown`` with ``drop`` and ``drop_pct`` against the point before the last; null without one or without a drop."""
    before = points.where("rank = 2").select(*key, F.col(value).alias("_before"))
    d = F.when(F.col("_before") > F.col(price), F.col("_before") - F.col(price))
    return shown.join(before, key, "left").withColumns({"drop": F.round(d, 2), "drop_pct": F.round(100 * d / F.col("_before")).cast("int")}).drop("_before")


def trend(points: DataFrame, *, key: list[str], day: str, value: str) -> DataFrame:
    """``(key, n, least, greatest, trend)``: first against last of series with at least 3 points and two values; trend -1, 0 or 1."""
    s = points.groupBy(*key).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.min_by(value, day).alias("_f"), F.max_by(value, day).alias("_l"))
    return s.where("n >= 3 and least < greatest").select(*key, "n", "least", "greatest", F.signum(F.col("_l") - F.col("_f")).cast("int").alias("trend"))


def upsert(stored: DataFrame, batch: DataFrame, *, key: str, order: str, overwrite: list[str], keep_known: list[str]) -> DataFrame:
    """The stored table after a batch: one full outer join, last row of a key in the batch wins.

    ``overwrite`` columns take the batch's value, ``keep_known`` the batch's
    unless it is null; keys missing in the batch stay as they are. Adds
    ``is_new``. Null keys are left out.
    """
    columns = [*overwrite, *keep_known]
    fresh = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order, *columns)).alias("b"))
    old = stored.select(key, F.struct(*columns).alias("s"))
    both = old.join(fresh, key, "full_outer")
    pick = [F.when(F.col("b").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in overwrite]
    pick += [F.coalesce(F.col(f"b.{c}"), F.col(f"s.{c}")).alias(c) for c in keep_known]
    return both.select(key, *pick, F.col("s").isNull().alias("is_new"))


def absences(sightings: DataFrame, runs: DataFrame, *, key: str, source: str, run: str, trusted: DataFrame | None, limit: int = 2) -> DataFrame:
    """``(key, source, absent, status)``: trusted runs in a row that lack a key, counted from its last sighting up to ``limit``.

    ``status``: ATIVO without an absence, INATIVO from ``limit`` on, SUSPEITO
    between. ``runs``: ``source, run``, the runs of each source in order;
    ``trusted``: the ``source, run`` pairs whose absence counts (None: all of
    them, an empty table: none). An untrusted run neither counts nor resets.
    """
    last = sightings.groupBy(key, source).agg(F.max(run).alias("_last"))
    n = F.least(F.size(_runs_after(F.col("_last"))), F.lit(limit))
    counted = last.join(_runs(runs, trusted, source, run), source, "left").select(key, source, n.alias("absent"))
    return counted.withColumn("status", F.when(F.col("absent") == 0, "ATIVO").when(F.col("absent") < limit, "SUSPEITO").otherwise("INATIVO"))


def lifecycle_events(sightings: DataFrame, runs: DataFrame, *, key: str, source: str, run: str, trusted: DataFrame | None, limit: int = 2) -> DataFrame:
    """``(key, source, run, kind)``: SUMIU at the ``limit``-th trusted run in a row that lacks a key, REAPARECEU at a sighting after at least one.

    The states of :func:`absences` over the whole history: each sighting looks
    at the trusted runs between it and the next one.
    """
    seen = sightings.select(key, source, run).distinct().withColumn("_next", F.lead(run).over(Window.partitionBy(key, source).orderBy(run)))
    gaps = seen.join(_runs(runs, trusted, source, run), source).withColumn("_gap", F.filter(_runs_after(F.col(run)), lambda r: F.col("_next").isNull() | (r < F.col("_next"))))
    gone = F.when(F.size("_gap") >= limit, F.struct(F.get("_gap", F.lit(limit - 1)).alias("run"), F.lit("SUMIU").alias("kind")))
    back = F.when((F.size("_gap") > 0) & F.col("_next").isNotNull(), F.struct(F.col("_next").alias("run"), F.lit("REAPARECEU").alias("kind")))
    return gaps.select(key, source, F.explode(F.array_compact(F.array(gone, back))).alias("e")).select(key, source, F.col("e.run").alias(run), F.col("e.kind").alias("kind"))


def _runs(runs: DataFrame, trusted: DataFrame | None, source: str, run: str) -> DataFrame:
    """The trusted runs of each source in order: as many as the schedule has, whatever the listings."""
    counted = runs if trusted is None else runs.join(trusted.select(source, run).distinct(), [source, run], "left_semi")
    return counted.select(source, run).distinct().groupBy(source).agg(F.sort_array(F.collect_list(run)).alias("_runs"))


def _runs_after(at: Column) -> Column:
    return F.filter(F.coalesce("_runs", F.array().cast("array<bigint>")), lambda r: r > at)


def seen_flags(stored: DataFrame, batch: DataFrame, *, key: str, source: str, seen: str, trusted: DataFrame | None) -> DataFrame:
    """``stored`` with the flag of the last run: 1 for keys of ``batch``, 0 for others of trusted sources; other sources keep theirs.

    ``trusted``: the sources (column ``source``) whose answer was whole; None:
    all of them, an empty table: none.
    """
    here = batch.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_here", F.lit(True))
    both = stored.join(here, key, "left")
    if trusted is None:
        gone = F.lit(True)
    else:
        both = both.join(trusted.select(source).distinct().withColumn("_trusted", F.lit(True)), source, "left")
        gone = F.col("_trusted").isNotNull()
    return both.withColumn(seen, F.when(F.col("_here").isNotNull(), 1).when(gone, 0).otherwise(F.col(seen)).cast("int")).select(*stored.columns)


def pruned(table: DataFrame, *, inactive: Column, last_seen: Column, run_date: str, days: int = 180) -> DataFrame:
    """Rows without those inactive and last seen more than ``days`` before ``run_date``; unknown dates stay."""
    gone = inactive & (F.datediff(F.lit(run_date).cast("date"), last_seen) > days)
    return table.where(~F.coalesce(gone, F.lit(False)))


def without_orphans(children: DataFrame, parents: DataFrame, *, child: str, parent: str) -> DataFrame:
    """Rows of ``children`` whose ``child`` column still names a parent; null references stay."""
    return children.where(F.col(child).isNull()).unionByName(children.join(parents.select(F.col(parent).alias(child)).where(f"{child} is not null").distinct(), child, "left_semi"))


def listing_events(stored: DataFrame, batch: DataFrame, *, key: str | list[str], price: str, texts: dict[str, str], status: str | None = None, absent: tuple[str, ...] = ("SUSPEITO", "INATIVO"), tolerance: float = 0.01) -> DataFrame:
    """``(key, kind, field, before, after, delta, delta_pct)``: what a batch changes in the stored table, one row per key on both sides.

    New keys give CRIADO with their price; known keys PRECO_ALTERADO if both
    prices are known and not 0 and differ by ``tolerance``, one event per text
    column of ``texts`` (column -> kind) whose hash changed between two
    non-empty values, and REAPARECEU if their status was absent. All come from
    one join, as filtered elements of one array. ``key`` may be several columns.
    """
    keys = [key] if isinstance(key, str) else key
    old = stored.select(*keys, F.lit(True).alias("_known"), _some(F.col(price)).alias("_p"), *[F.col(t).alias(f"_{t}") for t in texts], (F.col(status) if status else F.lit(None).cast("string")).alias("_status"))
    both = batch.dropna(subset=keys).select(*keys, _some(F.col(price)).alias("p"), *texts).join(old, keys, "left")
    return _exploded(both, keys, price=price, texts=texts, status=status, absent=absent, tolerance=tolerance)


def _some(c: Column) -> Column:
    return F.nullif(c.cast("double"), F.lit(0.0))


def _exploded(both: DataFrame, keys: list[str], *, price: str, texts: dict[str, str], status: str | None = None, absent: tuple[str, ...] = (), tolerance: float = 0.01, gone: Column | None = None) -> DataFrame:
    """The events of rows that hold both states (``_known, _p, p``, each text and its ``_`` twin, ``_status``); ``gone``: when there is a SUMIU too."""
    from vitrine.functions.text import text_hash

    text = lambda c: F.format_string("%.2f", c)
    event = lambda kind, field, before, after, x=None, y=None: F.struct(
        F.lit(kind).alias("kind"), F.lit(field).cast("string").alias("field"), before.cast("string").alias("before"), after.cast("string").alias("after"),
        (x if x is not None else F.lit(None).cast("double")).alias("x"), (y if y is not None else F.lit(None).cast("double")).alias("y"),
    )
    none = F.lit(None).cast("string")
    amount = lambda c: F.when(c.isNotNull(), text(c))
    known = F.coalesce("_known", F.lit(False))
    events = [
        F.when(~known, event("CRIADO", price, none, amount(F.col("p")))),
        F.when(known & (F.round(F.abs(F.col("p") - F.col("_p")), 9) >= tolerance), event("PRECO_ALTERADO", price, amount(F.col("_p")), amount(F.col("p")), F.col("_p"), F.col("p"))),
        *[F.when(known & (text_hash(F.col(t)) != text_hash(F.col(f"_{t}"))), event(kind, t, text_hash(F.col(f"_{t}")), text_hash(F.col(t)))) for t, kind in texts.items()],
        F.when(known & F.col("_status").isin(*absent), event("REAPARECEU", status or "", F.col("_status"), none)),
        *([F.when(gone, event("SUMIU", None, none, none))] if gone is not None else []),
    ]
    rows = both.select(*keys, F.explode(F.array_compact(F.array(*events))).alias("e")).select(*keys, "e.*")
    return event_deltas(rows, "x", "y").drop("x", "y")


def snapshot_log(rows: DataFrame, *, key: str, seq: str, last: int, price: str, texts: dict[str, str]) -> DataFrame:
    """``(key, seq, kind, field, before, after, delta, delta_pct)``: :func:`listing_events` between all consecutive snapshots 1..``last``.

    ``rows``: one per key and snapshot it is in. A key that was in an earlier
    snapshot but not in the one before gives REAPARECEU instead of CRIADO, one
    that is missing where it was in the one before SUMIU. The first snapshot
    has no events. Each row meets the one before in one window on the key.
    """
    order = Window.partitionBy(key).orderBy(seq)
    states = rows.select(key, seq, _some(F.col(price)).alias("p"), *texts)
    states = states.withColumns({f"_{x}": F.lag(x).over(order) for x in ("p", *texts)} | {"_before": F.lag(seq).over(order), "_next": F.lead(seq).over(order)})
    states = states.withColumns({"_known": F.col("_before") == F.col(seq) - 1, "_status": F.lit(None).cast("string")})
    gone = (F.col(seq) < last) & F.coalesce(F.col("_next") > F.col(seq) + 1, F.lit(True))
    events = _exploded(states, [key, seq, "_before"], price=price, texts=texts, gone=gone).where((F.col("kind") == "SUMIU") | (F.col(seq) > 1))
    back = (F.col("kind") == "CRIADO") & F.col("_before").isNotNull()
    at = F.when(F.col("kind") == "SUMIU", F.col(seq) + 1).otherwise(F.col(seq))
    return events.withColumns({seq: at, "kind": F.when(back, "REAPARECEU").otherwise(F.col("kind"))}).drop("_before")
