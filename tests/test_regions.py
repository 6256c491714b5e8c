import math
import random

from pyspark.sql import functions as F

from vitrine.operators import regions
from vitrine.operators.regions import containing_regions


def star(y, x, r, n, rnd):
    return [(y + r * rnd.uniform(0.5, 1) * math.sin(2 * math.pi * i / n), x + r * rnd.uniform(0.5, 1) * math.cos(2 * math.pi * i / n)) for i in range(n)]


def inside(ring, y, x):
    odd = False
    for (ay, ax), (by, bx) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay <= y) != (by <= y) and ax + (y - ay) * (bx - ax) / (by - ay) <= x:
            odd = not odd
    return odd


def run(spark, points, rings):
    p = spark.createDataFrame([(*q, "r") for q in points], "id string, lat double, lon double, region string")
    r = spark.createDataFrame([(n, [{"lat": float(a), "lon": float(b)} for a, b in ring], 1.0) for n, ring in rings], "region string, ring array<struct<lat:double,lon:double>>, lat double")
    found = containing_regions(p, r, id=F.col("id"), lat=F.col("lat"), lon=F.col("lon"), region=F.col("region"), ring=F.col("ring"))
    return sorted((x["id"], x["region"]) for x in found.collect())


def test_against_ray_casting(spark, monkeypatch):
    monkeypatch.setattr(regions, "CELL_POINTS", 20)
    monkeypatch.setattr(regions, "PAIRS_AT_ONCE", 16)
    rnd = random.Random(8)
    rings = [(f"r{i}{j}", star(0.3 * i, 0.3 * j, 0.14, 9, rnd)) for i in range(4) for j in range(4)]
    rings += [("outer", [(-1, -1), (-1, 2), (2, 2), (2, -1)]), ("holed", [(3, 0), (3, 2), (5, 2), (5, 0), (3, 0)]), ("holed", [(3.5, 0.5), (3.5, 1.5), (4.5, 1.5), (4.5, 0.5)]), ("thin", [(0, 0), (1, 1)])]
    points = [(f"p{i}", rnd.uniform(-1.2, 5.2), rnd.uniform(-1.2, 2.2)) for i in range(900)] + [("a", None, 1.0), ("b", float("nan"), 1.0), (None, 0.0, 0.0)]
    want = []
    for n, y, x in points[:900]:
        odd: dict = {}
        for name, ring in rings:
            if len(ring) > 2 and inside([c for k, c in enumerate(ring) if k == 0 or c != ring[0]], y, x):
                odd[name] = not odd.get(name, False)
        want += [(n, name) for name, o in odd.items() if o]
    assert run(spark, points, rings) == sorted(want)
    assert run(spark, [], rings) == [] and run(spark, points, []) == []


def test_regions_that_span_many_cells(spark):
    """An edge far to the left of a point decides about it, in cells that no boundary runs through."""
    rings = [("wide", [(0, -170), (0, 170), (1, 170), (1, -170)]), ("slanted", [(2, -60), (3, 40), (4, -60)]), ("inner", [(0.2, -5), (0.2, 5), (0.8, 5), (0.8, -5)])]
    points = [("a", 0.5, 0.0), ("b", 0.5, 100.0), ("c", 0.5, 175.0), ("d", 3.0, 39.0), ("e", 2.1, 39.0), ("f", 3.0, -59.0), ("g", 0.5, 0.0)]
    assert run(spark, points, rings) == [("a", "inner"), ("a", "wide"), ("b", "wide"), ("d", "slanted"), ("f", "slanted"), ("g", "inner"), ("g", "wide")]
