import math
import random

import numpy as np
from pyspark.sql import functions as F

from vitrine.operators import nearby
from vitrine.operators.nearby import near_pairs, near_spots, trapezoids

SCHEMA = "id string, lat double, lon double, slab string, cell int"


def metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))


def run(spark, points, radius=50.0):
    df = spark.createDataFrame([(*p, "x", 1) for p in points], SCHEMA)
    found = near_pairs(df, id=F.col("id"), lat=F.col("lat"), lon=F.col("lon"), radius=radius).collect()
    pairs = [(r["a"], r["b"]) for r in found]
    assert len(pairs) == len(set(pairs))
    return set(pairs)


def brute(points, radius=50.0):
    return {(min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(points) for b in points[:i] if a[0] != b[0] and metres(a, b) <= radius}


def test_random_points_hot_spots_poles_and_date_line(spark):
    rnd = random.Random(3)
    points = [(f"p{i}", -7 + rnd.random() * 0.004, -36 + rnd.random() * 0.004) for i in range(400)]
    points += [(f"h{i}", -7.0001, -36.0001) for i in range(30)]
    points += [(f"d{i}", 10 + rnd.random() * 1e-3, 180 - rnd.random() * 4e-4 if i % 2 else -180 + rnd.random() * 4e-4) for i in range(30)]
    points += [(f"n{i}", 90 - rnd.random() * 3e-4, rnd.random() * 360 - 180) for i in range(20)]
    assert run(spark, points) == brute(points)


def test_crowded_cells_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(nearby, "BLOCK", 7)
    monkeypatch.setattr(nearby, "PAIRS_AT_ONCE", 16)
    rnd = random.Random(4)
    points = [(f"p{i}", -7 + rnd.random() * 0.001, -36 + rnd.random() * 0.001) for i in range(150)] + [(f"h{i}", -7.0, -36.0) for i in range(40)]
    assert run(spark, points) == brute(points)


def test_unusable_and_repeated(spark):
    bad = [("a", None, 1.0), ("b", 0.0, 0.0), ("c", 91.0, 1.0), ("d", 1.0, -181.0), ("e", float("nan"), 1.0), (None, 1.0, 1.0), ("f", 1.0, None)]
    assert run(spark, [*bad, ("x", 1.0, 1.0), ("x", 1.0, 1.0), ("y", 1.0, 1.0)]) == {("x", "y")}
    assert run(spark, []) == set()


def test_other_radii_and_latitudes(spark):
    rnd = random.Random(5)
    for radius, lat, spread in ((2000.0, 71.0, 0.2), (5.0, -33.0, 2e-4), (90_000.0, 40.0, 4.0), (300.0, 89.5, 0.03)):
        points = [(f"p{i}", lat + rnd.uniform(-spread, spread), 12 + rnd.uniform(-spread, spread) / math.cos(math.radians(min(lat, 89)))) for i in range(150)]
        points = [(n, min(y, 90.0), x) for n, y, x in points]
        want = brute(points, radius)
        assert want and run(spark, points, radius) == want


def test_trapezoids_hold_their_discs():
    for lat in (0.0, -7.2, 60.0, 84.0):
        radius, h = 50.0, math.degrees(50.0 / 6_371_000)
        for step in range(-8, 9):
            low = lat + step * h / 8
            wide = math.degrees(math.asin(math.sin(50.0 / 6_371_000) / math.cos(math.radians(lat)))) * (1 + 1e-9)
            l0, l1, r0, r1 = (float(x[0]) for x in trapezoids(np.array([lat]), np.array([10.0]), np.array([wide]), low, low + h / 2, radius))
            assert r0 - 10 <= 1.25 * wide and r1 - 10 <= 1.25 * wide
            for k in range(101):
                y = low + h / 2 * k / 100
                if abs(y - lat) < h:
                    s = (math.sin(math.radians(h) / 2) ** 2 - math.sin(math.radians(y - lat) / 2) ** 2) / (math.cos(math.radians(lat)) * math.cos(math.radians(y)))
                    half = math.degrees(2 * math.asin(math.sqrt(max(s, 0))))
                    assert l0 + (l1 - l0) * k / 100 <= 10 - half + 1e-12 and r0 + (r1 - r0) * k / 100 >= 10 + half - 1e-12


def test_points_of_one_coordinate_are_one_class(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 50 + [(1.0, 1.0001)] * 50 + [(None, 1.0), (0.0, 0.0)], "lat double, lon double")
    assert [tuple(r) for r in near_spots(df, lat=F.col("lat"), lon=F.col("lon"), radius=50.0).collect()] == [(1.0, 1.0, 1.0, 1.0001)]
