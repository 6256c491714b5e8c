"""Points near other points: trapezoidal decomposition of discs into latitude slabs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.arrow_groups import map_groups

EARTH_RADIUS_M = 6_371_000.0
#: Slabs per search radius: how closely the trapezoids follow a disc.
SLABS = 2
#: Width of a slab's cell as a multiple of the search radius.
CELL_RADII = 64
#: Points and regions of one cell up to which the cell stays whole; larger cells are split into pairs of blocks.
BLOCK = 1024
#: Pairs held at once while a block is searched.
PAIRS_AT_ONCE = 1 << 19
#: Radius, and radius times the tangent of the latitude, up to which a disc is a circle in degrees but for terms the slack covers; beyond it trapezoids are as wide as the disc.
ROUND = 0.01


def usable(lat: Column, lon: Column) -> Column:
    """Whether a coordinate can be used: not null, not NaN, in range, not (0, 0)."""
    inside = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ~((lat == 0) & (lon == 0))
    return F.coalesce(inside & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def distance_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance on a sphere, in metres; null if a coordinate is."""
    h = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def expand(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges ``[begin, end)``, and which range each is of."""
    n = np.maximum(end - begin, 0)
    of = np.repeat(np.arange(len(n)), n)
    return np.repeat(begin, n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), of


def trapezoids(lat: np.ndarray, lon: np.ndarray, wide: np.ndarray, low: float, high: float, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Left and right edges, as longitudes at ``low`` and ``high``, of the trapezoids that hold the discs' parts in a slab.

    The edges touch the disc in the middle of its part of the slab, so the
    trapezoid holds all of it; ``wide``: half the width of the whole disc.
    """
    angle = radius / EARTH_RADIUS_M
    h = math.degrees(angle) * (1 + 1e-9)
    u0, u1 = np.clip((low - lat) / h, -1, 1), np.clip((high - lat) / h, -1, 1)
    um = (u0 + u1) / 2
    c = np.sqrt(np.maximum(1 - um * um, 1e-12))
    tilt = np.abs(np.tan(np.radians(np.clip(lat, -89.999999, 89.999999)))) * angle
    width = h / np.maximum(np.cos(np.radians(lat)), 1e-12) * (1 + tilt + 2 * angle**2 + 2 * tilt**2)
    # Half-widths where the slab cuts the tangent; edges go on to the slab's ends.
    at = lambda y: np.maximum(width * (1 - um * (y - lat) / h) / c, 0.0)
    straight = (tilt > ROUND) | (angle > ROUND)
    w0, w1 = np.where(straight, wide, at(low)), np.where(straight, wide, at(high))
    return lon - w0, lon - w1, lon + w0, lon + w1


def _search(radius: float, height: float):
    """Within one cell of a slab: the edges of the trapezoids cut it into ordered intervals; each point finds its own by binary search."""

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        region = group.column("is_region").to_numpy()
        lat, lon, turned, wide, home = (group.column(c).to_numpy() for c in ("lat", "lon", "turned", "wide", "home"))
        slab = group.column("slab")[0].as_py()
        low = slab * height - 90
        r, p = np.flatnonzero(region), np.flatnonzero(~region)
        if not len(r) or not len(p):
            return
        l0, l1, r0, r1 = trapezoids(lat[r], turned[r], wide[r], low, low + height, radius)
        first, last = np.minimum(l0, l1), np.nextafter(np.maximum(r0, r1), np.inf)
        cuts = np.unique(np.concatenate([first, last]))
        interval = np.searchsorted(cuts, lon[p], "right")
        held, of_point = np.unique(interval, return_inverse=True)
        # The trapezoids over each interval that holds points.
        over, which = expand(np.searchsorted(held, np.searchsorted(cuts, first, "right")), np.searchsorted(held, np.searchsorted(cuts, last, "right")))
        order = np.argsort(over, kind="stable")
        listed = which[order]
        begin = np.searchsorted(over[order], np.arange(len(held) + 1))
        lo, hi = begin[of_point], begin[of_point + 1]
        ends = np.cumsum(hi - lo)
        at = 0
        while at < len(p):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            found, of = expand(lo[at:end], hi[at:end])
            t, j = listed[found], p[at:end][of]
            part = (lat[j] - low) / height
            inside = (lon[j] >= l0[t] + (l1[t] - l0[t]) * part - 1e-12) & (lon[j] <= r0[t] + (r1[t] - r0[t]) * part + 1e-12)
            i, j = r[t[inside]], j[inside]
            a, b = np.radians(lat[i]), np.radians(lat[j])
            h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon[j] - lon[i]) / 2) ** 2
            # Within one slab both discs hold the other's centre: keep one of the two; across slabs only the upper neighbour is searched.
            once = (home[i] != slab) | (lat[i] < lat[j]) | ((lat[i] == lat[j]) & (lon[i] < lon[j]))
            ok = once & (2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(h, 1.0))) <= radius)
            i, j = i[ok], j[ok]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (lat[i], lon[i], lat[j], lon[j])], names=["lat_a", "lon_a", "lat_b", "lon_b"])
            at = end

    return run


def near_spots(points: DataFrame, *, lat: Column, lon: Column, radius: float) -> DataFrame:
    """``(lat_a, lon_a, lat_b, lon_b)``: pairs of different coordinates at most ``radius`` metres apart, each pair once.

    Coordinates are the classes of the points on them: rows of one coordinate
    are never paired with one another here, however many there are. Unusable
    coordinates (see :func:`usable`) are in no pair.

    Each coordinate is the centre of a region, a disc. Slabs of latitude,
    ``SLABS`` to a radius, cut the discs into trapezoids whose left and right
    edges touch the disc; a disc is entered into its own slab and those above
    it (the pair with a slab below is found from the other centre), each point
    into its own slab; cells of longitude distribute a slab. In a cell the
    edges are ordered into intervals, each with the trapezoids over it; a point
    finds its interval by binary search and is held against the edges of those
    trapezoids; the exact distance decides. A crowded cell (more than ``BLOCK``
    points or regions) is split into blocks of regions and points and every
    pair of blocks is searched on its own, so that no task holds more than two
    blocks and no pair is lost.
    """
    angle = radius / EARTH_RADIUS_M
    height = math.degrees(angle) * (1 + 1e-9) / SLABS
    cell = height * SLABS * CELL_RADII
    spots = points.select(lat.cast("double").alias("lat"), lon.cast("double").alias("lon")).where(usable(F.col("lat"), F.col("lon"))).distinct()
    # Widest half-angle of longitude a disc at this latitude reaches; all around at the poles.
    nearest_pole = F.radians(F.lit(90.0) - F.abs("lat"))
    reach = F.when(nearest_pole <= angle * 1.0001, F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(angle)) / F.cos(F.radians("lat"))))) * (1 + 1e-9))
    spots = spots.select("lat", "lon", F.floor((F.col("lat") + 90) / height).cast("long").alias("home"), reach.alias("wide"))
    cells = lambda x: F.floor((x + 540) / cell).cast("long")
    as_point = spots.select("lat", "lon", "home", F.lit(False).alias("is_region"), F.col("lon").alias("turned"), F.lit(0.0).alias("wide"), F.col("home").alias("slab"), cells(F.col("lon")).alias("cell"))
    # Across the date line a region is entered a second and third time, a turn to either side.
    turns = F.explode(F.filter(F.array(F.lit(0.0), F.lit(360.0), F.lit(-360.0)), lambda t: ((t == 0) | (F.col("wide") < 360)) & (F.col("lon") + F.col("wide") + t >= -180) & (F.col("lon") - F.col("wide") + t <= 180)))
    regions = spots.select("*", turns.alias("turn")).select("lat", "lon", "home", F.lit(True).alias("is_region"), (F.col("lon") + F.col("turn")).alias("turned"), "wide", F.explode(F.sequence(F.col("home"), F.col("home") + SLABS)).alias("slab"))
    regions = regions.where(F.col("slab") * height - 90 <= F.col("lat") + height * SLABS)
    # Trapezoids are a little wider than the disc where the tangent leaves it.
    left, right = (F.greatest(F.col("turned") - F.col("wide") * 1.25, F.lit(-180.0)), F.least(F.col("turned") + F.col("wide") * 1.25, F.lit(180.0)))
    regions = regions.select("lat", "lon", "home", "is_region", "turned", "wide", "slab", F.explode(F.sequence(cells(left), cells(right))).alias("cell"))
    entered = as_point.unionByName(regions)
    # Crowded cells, counted with map-side combination; the list of them is short and joined by size.
    most = F.greatest(F.count_if("is_region"), F.count_if(~F.col("is_region")))
    crowded = entered.groupBy("slab", "cell").agg(most.alias("n"), F.count_if(~F.col("is_region")).alias("points")).where(f"n > {BLOCK} and points > 0").select("slab", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    both = entered.join(crowded, ["slab", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("lat", "lon"), F.col("blocks")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = both.withColumns({"own": own, "other": others})
    placed = placed.select(*both.drop("blocks").columns, F.when(F.col("is_region"), F.col("own")).otherwise(F.col("other")).alias("region_block"), F.when(F.col("is_region"), F.col("other")).otherwise(F.col("own")).alias("point_block"))
    keys = ["slab", "cell", "region_block", "point_block"]
    return map_groups(placed, keys, [], _search(radius, height), "lat_a double, lon_a double, lat_b double, lon_b double")


def near_pairs(points: DataFrame, *, id: Column, lat: Column, lon: Column, radius: float) -> DataFrame:
    """``(a, b)``, ids as strings, a < b: all pairs of points at most ``radius`` metres apart.

    The pairs of :func:`near_spots` and the points of one coordinate written
    out; where that is more than is wanted, take the classes from there.
    Unusable coordinates and null ids have no neighbours, repeated rows count
    once; an id with several different coordinates is several points, whose
    pairs may come more than once.
    """
    members = points.select(id.cast("string").alias("id"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon")).where(F.col("id").isNotNull() & usable(F.col("lat"), F.col("lon"))).distinct()
    near = near_spots(members, lat=F.col("lat"), lon=F.col("lon"), radius=radius)
    spots = members.select("lat", "lon").distinct().select(F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    side = lambda s: members.select(F.col("id").alias(f"id_{s}"), F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}"))
    met = near.unionByName(spots).join(side("a"), ["lat_a", "lon_a"]).join(side("b"), ["lat_b", "lon_b"])
    same = (F.col("lat_a") == F.col("lat_b")) & (F.col("lon_a") == F.col("lon_b"))
    met = met.where(F.when(same, F.col("id_a") < F.col("id_b")).otherwise(F.col("id_a") != F.col("id_b")))
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
