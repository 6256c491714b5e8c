"""Filters with three outcomes, enrichment, scoring against the current list, marks and facets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bound:
    """An inclusive range of a column that may be unknown."""

    column: str
    least: Column | None = None
    most: Column | None = None


def verdict(bounds: list[Bound], needed: list[tuple[str, Column]]) -> Column:
    """``struct(verdict, reasons)``: REPROVADO if a known value is out of its range, INDETERMINADO if something needed is unknown, else APROVADO.

    ``needed``: (reason, condition under which it is unknown). Reasons are given for the undetermined only.
    """
    out = F.lit(False)
    for b in bounds:
        for limit, bad in ((b.least, lambda c, x: c < x), (b.most, lambda c, x: c > x)):
            if limit is not None:
                out = out | F.coalesce(bad(F.col(b.column), limit), F.lit(False))
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in needed]))
    kind = F.when(out, "REPROVADO").when(F.size(reasons) > 0, "INDETERMINADO").otherwise("APROVADO")
    return F.struct(kind.alias("verdict"), F.when(kind == "INDETERMINADO", reasons).otherwise(F.array().cast("array<string>")).alias("reasons"))


def with_profile(rows: DataFrame, profiles: DataFrame, *, key: str, columns: list[str], default: str) -> DataFrame:
    """``rows`` with the profile of their key, or the default key's (one row, read first) where they have none; the profiles are joined by size."""
    fallback = profiles.where(F.col(key) == default).select(*columns).first()
    joined = rows.join(profiles.select(key, *columns), key, "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col(c), F.lit(fallback[c] if fallback else None)).alias(c) for c in columns])


def filled(rows: DataFrame, extra: DataFrame, *, key: str, columns: list[str], longer: list[str] = ()) -> DataFrame:
    """``rows`` with nulls filled from ``extra`` (one row per key); of ``longer`` array columns the longer one stays."""
    side = extra.select(key, *[F.col(c).alias(f"_{c}") for c in (*columns, *longer)])
    joined = rows.join(side, key, "left")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    new = {c: F.coalesce(c, f"_{c}") for c in columns} | {c: F.when(size(F.col(f"_{c}")) > size(F.col(c)), F.col(f"_{c}")).otherwise(F.col(c)) for c in longer}
    return joined.withColumns(new).select(*rows.columns)


def first_per_key(rows: DataFrame, *, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order`` (which should settle all ties)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def scaled(column: Column, least: Column, most: Column, inverted: bool = False) -> Column:
    """Position within a range, clamped to 0..1; null if the range is empty or the value unknown."""
    # greatest and least pass over nulls, so an unknown value is left out first.
    x = F.when((most > least) & column.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (column - least) / (most - least))))
    return 1 - x if inverted else x


def weighted_score(criteria: list[tuple[str, float, Column]]) -> Column:
    """100 times the weighted mean of the criteria that are known."""
    above = sum((F.coalesce(v * w, F.lit(0.0)) for _, w, v in criteria), F.lit(0.0))
    below = sum((F.when(v.isNotNull(), w).otherwise(0.0) for _, w, v in criteria), F.lit(0.0))
    return 100 * F.try_divide(above, below)


def affinity(rows: DataFrame, *, ranges: dict[str, tuple[str, float, bool]], flags: dict[str, tuple[Column, float]], penalty: Column, eligible: Column, badges: int = 3, floor: float = 45.0, above_mean: float = 1.25, ties: list[str], preferred: Column | None = None) -> DataFrame:
    """``rows`` with ``score``, ``reasons`` and ``badge``, relative to the list itself.

    ``ranges``: criterion -> (column, weight, inverted), scaled between the
    list's least and greatest value; ``flags``: criterion -> (value 0..1,
    weight). Extremes and the mean are one-row aggregates read first, no
    global window. The score is multiplied by ``penalty``; the badge goes to
    the first ``badges`` eligible rows that reach max(floor, above_mean x mean),
    or, if badges are restricted to ``preferred`` rows, to the first of those,
    whatever their score.
    """
    x = rows.agg(*[f(c).alias(f"{k}_{s}") for k, (c, _, _) in ranges.items() for s, f in (("lo", F.min), ("hi", F.max))]).first()
    criteria = [(k, w, scaled(F.col(c), F.lit(x[f"{k}_lo"]), F.lit(x[f"{k}_hi"]), inv)) for k, (c, w, inv) in ranges.items()] + [(k, w, v) for k, (v, w) in flags.items()]
    reasons = F.slice(F.array_compact(F.array(*[F.when(v >= 0.7, F.lit(k)) for k, _, v in criteria])), 1, 3)
    scored = rows.select(*rows.columns, F.bround(weighted_score(criteria) * penalty).cast("int").alias("score"), reasons.alias("reasons"), F.coalesce(eligible, F.lit(False)).alias("_eligible"))
    mean = scored.agg(F.avg("score")).first()[0] or 0.0
    good = F.col("score") >= max(floor, above_mean * mean) if preferred is None else F.coalesce(preferred, F.lit(False))
    marked = scored.withColumn("_able", F.col("_eligible") & good)
    top = marked.where("_able").orderBy(F.desc("score"), *ties).limit(badges).select(*ties, F.lit(True).alias("badge"))
    return marked.join(F.broadcast(top), ties, "left").withColumn("badge", F.coalesce("badge", F.lit(False))).drop("_eligible", "_able")


def merged_marks(seed: DataFrame, local: DataFrame, *, key: str, value: str) -> DataFrame:
    """Union of two mark tables; the local value wins."""
    return seed.select(key, F.col(value).alias("_s")).join(local.select(key, F.col(value).alias("_l")), key, "full_outer").select(key, F.coalesce("_l", "_s").alias(value))


def toggled(marks: DataFrame, keys: DataFrame, *, key: str) -> DataFrame:
    """Marks with the given keys removed if any of them is marked, else with all of them added."""
    any_marked = not marks.join(keys, key, "left_semi").isEmpty()
    return marks.join(keys, key, "left_anti") if any_marked else marks.select(key).unionByName(keys.select(key)).distinct()


def best_gallery(rows: DataFrame, *, entity: str, photos: str, order: str, limit: int = 12) -> DataFrame:
    """The longest photo list of each entity (ties: the least ``order``), cut to ``limit``."""
    key = F.struct(F.size(photos), (-F.col(order)).alias("o"))
    return rows.where(F.size(photos) > 0).groupBy(entity).agg(F.slice(F.max_by(photos, key), 1, limit).alias(photos))


def capped_by_host(rows: DataFrame, *, order: list[str], host: str, failed: Column, most: int, give_up: int = 2) -> DataFrame:
    """The rows a visitor would visit: in order, hosts dropped after ``give_up`` failures, at most ``most`` in all."""
    w = Window.partitionBy(host).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    live = rows.withColumn("_f", F.coalesce(F.sum(F.when(failed, 1).otherwise(0)).over(w), F.lit(0))).where(F.col("_f") < give_up).drop("_f")
    return live.orderBy(*order).limit(most)


def visit_slots(rows: DataFrame, *, domain: str, order: list[str], delays: DataFrame, most: float = 30.0) -> DataFrame:
    """``rows`` with ``slot``, seconds from the start: visits of a domain keep its greatest crawl delay (capped, non-positive ignored)."""
    per = delays.where("delay > 0").groupBy(domain).agg(F.least(F.max("delay"), F.lit(most)).alias("_d"))
    n = F.row_number().over(Window.partitionBy(domain).orderBy(*order)) - 1
    return rows.join(per, domain, "left").withColumn("slot", n * F.coalesce("_d", F.lit(0.0))).drop("_d")
