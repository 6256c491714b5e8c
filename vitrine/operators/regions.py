"""Which region holds each point: trapezoidal decomposition of the boundaries into slabs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.arrow_groups import map_groups
from vitrine.operators.nearby import expand

#: Points of a cell up to which it stays whole; beyond it the points are spread over copies of the cell's edges.
CELL_POINTS = 200_000
#: Width of a cell in slab heights.
CELL_SLABS = 8
#: Pairs held at once while a cell is searched.
PAIRS_AT_ONCE = 1 << 20


def _locate(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """Within one cell: cut again at every vertex, so that edges run through and are ordered; each point finds the edges left of it by binary search."""
    edge = group.column("is_edge").to_numpy()
    names = group.column("name").combine_chunks()
    y0, x0, y1, x1 = (group.column(c).to_numpy() for c in ("y0", "x0", "y1", "x1"))
    e, p = np.flatnonzero(edge), np.flatnonzero(~edge)
    if not len(e) or not len(p):
        return
    cuts = np.unique(np.concatenate([y0[e], y1[e]]))
    part = np.searchsorted(cuts, y0[p], "right") - 1
    p, part = p[(part >= 0) & (part < len(cuts) - 1)], part[(part >= 0) & (part < len(cuts) - 1)]
    # The parts that hold points, and the edges through each, from left to right.
    held, of_point = np.unique(part, return_inverse=True)
    through, which = expand(np.searchsorted(held, np.searchsorted(cuts, y0[e])), np.searchsorted(held, np.searchsorted(cuts, y1[e])))
    slope = (x1 - x0) / np.where(y1 > y0, y1 - y0, 1.0)
    at = lambda y, i: x0[i] + (y - y0[i]) * slope[i]
    middle = (cuts[held[through]] + cuts[held[through] + 1]) / 2
    order = np.lexsort((at(middle, e[which]), through))
    edges = e[which[order]]
    begin = np.searchsorted(through[order], np.arange(len(held) + 1))
    left, right = begin[of_point], begin[of_point + 1]
    while (open_ := left < right).any():
        mid = (left + right) // 2
        passed = open_ & (at(y0[p], edges[np.minimum(mid, len(edges) - 1)]) <= x0[p])
        left, right = np.where(passed, mid + 1, left), np.where(open_ & ~passed, mid, right)
    # Points between the same two edges are in the same trapezoid; it lies in the regions with an odd number of edges to its left.
    place, of = np.unique(np.stack([of_point, left]), axis=1, return_inverse=True)
    region = names.dictionary_encode()
    code = region.indices.to_numpy(zero_copy_only=False)
    lo, hi = begin[place[0]], place[1]
    ends = np.cumsum(hi - lo)
    by_place = np.argsort(of, kind="stable")
    of = of[by_place]
    k = 0
    while k < len(lo):
        end = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS_AT_ONCE, "right")))
        found, own = expand(lo[k:end], hi[k:end])
        pairs, times = np.unique(np.stack([own, code[edges[found]]]), axis=1, return_counts=True)
        inside, regions = pairs[:, times % 2 == 1]
        row, times = expand(np.searchsorted(of, inside + k, "left"), np.searchsorted(of, inside + k, "right"))
        if len(row):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(p[by_place[row]])), region.dictionary.take(pa.array(regions[times]))], names=["id", "region"])
        k = end


def containing_regions(points: DataFrame, regions: DataFrame, *, id: Column, lat: Column, lon: Column, region: Column, ring: Column, slab: float = 0.05) -> DataFrame:
    """``(id, region)``, both as strings: the regions each point lies in.

    ``ring``: array of struct(lat, lon), closed or not; rings of one region add
    up by parity, so holes are rings of their own. Boundaries of regions may
    touch or nest but not cross. A point on a left or lower boundary is inside,
    on a right or upper one outside. Points without usable numbers, null ids,
    and rings of fewer than three vertices are in no result; repeated points
    come once per repeat.

    Edges are cut into slabs of ``slab`` degrees of latitude and entered into
    the slab's cells from their own to the last one their region reaches: what
    lies left of a point within its region is in the point's cell, so no task
    holds a band around the globe. A cell with very many points is searched in
    several copies of about ``CELL_POINTS`` points.
    """
    number = lambda c: F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    cells = lambda x: F.floor(x / (slab * CELL_SLABS)).cast("long")
    spots = points.select(id.cast("string").alias("name"), number(lat).alias("y0"), number(lon).alias("x0")).where("name is not null and y0 is not null and x0 is not null")
    spots = spots.select(F.lit(False).alias("is_edge"), "name", "y0", "x0", F.col("y0").alias("y1"), F.col("x0").alias("x1"), F.floor(F.col("y0") / slab).cast("long").alias("slab"), cells(F.col("x0")).alias("cell"))
    rings = regions.select(region.cast("string").alias("name"), ring.alias("ring")).where("name is not null and size(ring) >= 3")
    corner = lambda i: F.element_at("ring", i)
    sides = F.transform(F.sequence(F.lit(1), F.size("ring")), lambda i: F.struct(corner(i).alias("a"), corner(i % F.size("ring") + 1).alias("b")))
    reach = F.array_max(F.transform("ring", lambda v: v["lon"]))
    e = rings.select("name", reach.alias("reach"), F.explode(sides).alias("e")).select("name", "reach", *[F.col(f"e.{v}.{c}").alias(v + c) for v in "ab" for c in ("lat", "lon")]).where("alat <> blat")
    up = F.col("alat") < F.col("blat")
    pick = lambda c, lower: F.when(up == lower, F.col(f"a{c}")).otherwise(F.col(f"b{c}"))
    edges = e.select(F.lit(True).alias("is_edge"), "name", pick("lat", True).alias("y0"), pick("lon", True).alias("x0"), pick("lat", False).alias("y1"), pick("lon", False).alias("x1"), "reach")
    edges = edges.withColumn("slab", F.explode(F.sequence(F.floor(F.col("y0") / slab).cast("long"), F.floor(F.col("y1") / slab).cast("long"))))
    edges = edges.withColumn("cell", F.explode(F.sequence(cells(F.least("x0", "x1")), cells(F.greatest("reach", "x0", "x1"))))).drop("reach")
    crowded = spots.groupBy("slab", "cell").count().where(f"count > {CELL_POINTS}").select("slab", "cell", F.ceil(F.col("count") / CELL_POINTS).cast("int").alias("copies"))
    both = spots.unionByName(edges).join(crowded, ["slab", "cell"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    copy = F.when(F.col("is_edge"), F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array(F.pmod(F.xxhash64("name", "y0", "x0"), F.col("copies")).cast("int")))
    return map_groups(both.withColumn("copy", F.explode(copy)).drop("copies"), ["slab", "cell", "copy"], [], _locate, "id string, region string")
