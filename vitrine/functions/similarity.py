"""Comparators of two listings: each between 0 and 1, null if either side lacks what it needs.

``a`` and ``b`` are struct columns made by :func:`prepared`; a registry maps
comparator names to functions of both.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import digits, jaccard, plain_words, tokens

# Metres in a degree of latitude, and of longitude at the equator.
LATITUDE_M, LONGITUDE_M = 110_540.0, 111_320.0


def decay(difference: Column, tolerance: float, limit: float) -> Column:
    """1 up to ``tolerance``, 0 from ``limit`` on, linear between; null for an unknown difference."""
    return F.when(difference.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (limit - difference) / (limit - tolerance))))


def relative(x: Column, y: Column) -> Column:
    """Difference over the greater value; null for null or non-positive values."""
    return F.when((x > 0) & (y > 0), F.abs(x - y) / F.greatest(x, y))


def flat_distance(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Metres by the equirectangular projection at ``lat_a``."""
    return F.hypot((lat_a - lat_b) * LATITUDE_M, (lon_a - lon_b) * LONGITUDE_M * F.cos(F.radians(lat_a)))


def photo_names(photos: Column) -> Column:
    """What identifies photos across hosts: a long hexadecimal part of the path, else the file's stem."""
    long_hex = lambda u: F.nullif(F.regexp_extract(u, r"/([0-9a-f]{16,})[/.]", 1), F.lit(""))
    stem = lambda u: F.nullif(F.regexp_extract(F.lower(u), r"/([^/?]+)\.(?:jpe?g|webp|png)", 1), F.lit(""))
    return F.array_distinct(F.array_compact(F.transform(photos, lambda u: F.coalesce(long_hex(u), stem(u)))))


def cost(total: Column, price: Column) -> Column:
    """Total cost, or the price where the total is missing or 0."""
    return F.coalesce(F.nullif(total, F.lit(0.0)), price)


def prepared() -> Column:
    """What the comparators need of a listing, worked out once per row instead of once per pair."""
    c = F.col
    some = lambda x: F.nullif(x, F.lit(""))
    # Words of a text that is there; one without any is like no other.
    said = lambda x: F.when(x != "", tokens(x))
    filled = lambda x: F.when(F.size(x) > 0, x)
    return F.struct(
        "latitude", "longitude", "area_m2", "quartos", "suites", "banheiros", "vagas", "site",
        said(c("logradouro")).alias("street"),
        some(c("numero").cast("string")).alias("number"),
        said(c("condominio_nome")).alias("building"),
        F.when(F.length("descricao") >= 60, tokens(c("descricao"))).alias("description"),
        said(c("imobiliaria")).alias("agency"),
        F.right(digits(c("telefone")), F.lit(8)).alias("phone"),
        F.when(c("cidade") != "", plain_words(c("cidade"))).alias("city"),
        filled(photo_names(c("fotos"))).alias("photos"),
        cost(c("custo_mensal_total"), c("preco")).alias("cost"),
    )


def _position(a: Column, b: Column) -> Column:
    d = flat_distance(a["latitude"], a["longitude"], b["latitude"], b["longitude"])
    return F.when(d < 50, 1.0).when(d < 150, 0.7).when(d < 400, 0.3).when(d.isNotNull(), 0.0)


def _overlap(a: Column, b: Column) -> Column:
    """:func:`jaccard` of two texts' words, 0 if a text that is there has none."""
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(jaccard(a, b), F.lit(0.0)))


def _address(a: Column, b: Column) -> Column:
    base = _overlap(a["street"], b["street"])
    return F.when(base.isNull() | a["number"].isNull() | b["number"].isNull(), base).when(a["number"] == b["number"], F.least(F.lit(1.0), base + 0.3)).otherwise(base * 0.5)


def _rooms(a: Column, b: Column) -> Column:
    fields = ("quartos", "suites", "banheiros", "vagas")
    both = [a[f].isNotNull() & b[f].isNotNull() for f in fields]
    known = sum((k.cast("int") for k in both), F.lit(0))
    equal = sum((F.when(k & (a[f] == b[f]), 1).otherwise(0) for f, k in zip(fields, both, strict=True)), F.lit(0))
    return F.when(known > 0, equal / known)


def _contact(a: Column, b: Column) -> Column:
    phones = a["phone"].isNotNull() & b["phone"].isNotNull()
    return F.when(phones, (a["phone"] == b["phone"]).cast("double")).otherwise(_overlap(a["agency"], b["agency"]))


COMPARATORS: dict[str, Callable[[Column, Column], Column]] = {
    "geo": _position,
    "endereco": _address,
    "area": lambda a, b: decay(relative(a["area_m2"], b["area_m2"]), 0.02, 0.12),
    "custo": lambda a, b: decay(relative(a["cost"], b["cost"]), 0.01, 0.15),
    "fotos": lambda a, b: jaccard(a["photos"], b["photos"]),
    "comodos": _rooms,
    "condominio": lambda a, b: _overlap(a["building"], b["building"]),
    "descricao": lambda a, b: _overlap(a["description"], b["description"]),
    "contato": _contact,
}


@dataclass(frozen=True)
class MatchPolicy:
    """Weights, class bounds and vetoes of a comparison."""

    weights: dict[str, float] = field(default_factory=lambda: {"geo": 0.20, "endereco": 0.18, "area": 0.15, "custo": 0.12, "fotos": 0.12, "comodos": 0.08, "condominio": 0.06, "descricao": 0.05, "contato": 0.04})
    same: float = 0.88
    probably_same: float = 0.72
    probably_different: float = 0.55
    least_signals: int = 3
    rooms_apart: int = 2
    area_apart: float = 0.25


def veto(a: Column, b: Column, policy: MatchPolicy) -> Column:
    """Why two listings can't be the same dwelling; null if nothing speaks against it."""
    return (
        F.when(a["city"] != b["city"], "cidade")
        .when(F.abs(a["quartos"] - b["quartos"]) >= policy.rooms_apart, "quartos")
        .when(relative(a["area_m2"], b["area_m2"]) > policy.area_apart, "area")
        .when((a["site"] == b["site"]) & (a["site"] != ""), "mesma_fonte")
    )


def compared(pairs: DataFrame, policy: MatchPolicy | None = None) -> DataFrame:
    """``pairs`` with structs ``ra``, ``rb`` (see :func:`prepared`) replaced by ``raw, score, class, signals, veto, n``.

    The score is the weighted mean of the comparators that have data, 0 under a
    veto. Each step is a projection of its own, so no comparator is evaluated twice.
    """
    policy = policy or MatchPolicy()
    kept = [c for c in pairs.columns if c not in ("ra", "rb")]
    names = list(policy.weights)
    checked = pairs.withColumn("veto", veto(F.col("ra"), F.col("rb"), policy))
    values = [F.when(F.col("veto").isNull(), COMPARATORS[k](F.col("ra"), F.col("rb"))).alias(f"_{k}") for k in names]
    signalled = checked.select(*kept, "veto", *values)
    above = sum((F.coalesce(F.col(f"_{k}") * w, F.lit(0.0)) for k, w in policy.weights.items()), F.lit(0.0))
    below = sum((F.when(F.col(f"_{k}").isNotNull(), w).otherwise(0.0) for k, w in policy.weights.items()), F.lit(0.0))
    n = sum((F.col(f"_{k}").isNotNull().cast("int") for k in names), F.lit(0))
    scored = signalled.select("*", F.coalesce(F.try_divide(above, below), F.lit(0.0)).alias("raw"), n.alias("n"))
    sure = (F.col("raw") >= policy.same) & (F.col("n") >= policy.least_signals)
    if "custo" in names:
        sure = sure & ~F.coalesce(F.round("_custo", 3) == 0, F.lit(False))
    label = (
        F.when(F.col("veto").isNotNull() | (F.col("n") == 0), "DIFERENTE")
        .when(sure, "MESMO_IMOVEL")
        .when(F.col("raw") >= policy.probably_same, "PROVAVELMENTE_MESMO")
        .when(F.col("raw") >= policy.probably_different, "PROVAVELMENTE_DIFERENTE")
        .otherwise("DIFERENTE")
    )
    signals = F.struct(*[F.round(f"_{k}", 3).alias(k) for k in names])
    return scored.select(*kept, "raw", F.round("raw", 4).alias("score"), label.alias("class"), signals.alias("signals"), "veto", "n")
