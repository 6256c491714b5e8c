from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vitrine.llm.linkage import link, rescored, with_areas, with_buildings
from vitrine.llm.linkage_queries import p3_links
from vitrine.session import shared_dir

SCHEMA = "id string, building bigint, city string, street string, zip string, lat double, lon double, rooms int, area double, price double, floor int, fee double, tax double, n int, found string"


def rec(id_, building=None, area=None, rooms=None, price=None, floor=None, lat=None, lon=None, street="", fee=None, tax=None):
    return (id_, building, "x", street, "", lat, lon, rooms, area, price, floor, fee, tax, 1, "y")


def matches(spark, left, right):
    got = link(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)).collect()
    assert all(0 < r["confidence"] <= 1 for r in got) and len(got) == len({(r["l"], r["r"]) for r in got})
    return {(r["l"], r["r"]) for r in got}


def test_links(spark):
    left = [rec("F1", 1, 70.0, 2, 1500.0), rec("F2", 1, 90.0, 3, 2500.0), rec("F3", None, 55.0, 2, 1200.0, lat=-7.10001, lon=-36.1), rec("F4", 2, None, 2), rec("F5", None, None)]
    right = [
        rec("L1", 1, 70.5, 2, 1550.0, floor=4),
        rec("L2", 1, None, 2, 1555.0, floor=4),
        rec("L3", 1, 90.0, 2, 2500.0),
        rec("L4", 1, 91.0, None, 2600.0),
        rec("L5", 3, 55.2, 2, 1210.0, lat=-7.10001, lon=-36.1),
        rec("L6", 3, 54.8, 2, 1190.0, lat=-7.10001, lon=-36.1),
        rec("L7", 2, 70.0, 2, 1500.0),
        rec("L8", None, None),
    ]
    assert matches(spark, left, right) == {("F1", "L1"), ("F1", "L2"), ("F2", "L4"), ("F3", "L5"), ("F3", "L6")}


def test_surroundings_and_vague_spots(spark):
    spot = dict(lat=-7.20001, lon=-36.2)
    left = [rec("F1", None, 60.0, 2, 1500.0, lat=-7.10003, lon=-36.10003), rec("F2", None, 80.0, 2, 1500.0, **spot)]
    right = [rec("L1", 1, 60.0, 2, 1500.0, lat=-7.10001, lon=-36.1), *[rec(f"M{i}", 10 + i, 80.0, 2, 1500.0, **spot) for i in range(5)]]
    assert matches(spark, left, right) == {("F1", "L1")}


def test_records_without_area_on_either_side(spark):
    left = [
        rec("F1", 1, None, 2, 1500.0),
        rec("F2", 2, None, None, 2000.0),
        rec("F3", 3, 50.0, 1, 1000.0),
        rec("F4", 4, None, 3, 3000.0),
        rec("F5", 5, None, 2, 900.0),
    ]
    right = [
        rec("L1", 1, 70.0, 2, 1450.0),
        rec("L2", 1, 70.5, 2, 1520.0),
        rec("L3", 1, 90.0, 3, 1500.0),
        rec("L4", 1, 70.0, 2, 2500.0),
        # Two dwellings in reach: the one nearer in price.
        rec("L5", 2, 80.0, 3, 1990.0),
        rec("L6", 2, 110.0, 3, 2200.0),
        # Neither area nor rooms nor a sized listing beside it.
        rec("L7", 3, None, None, 1010.0),
        rec("L8", 3, None, 2, 1010.0),
        # Neither side sized.
        rec("L9", 4, None, 3, 3050.0),
        rec("L10", 4, None, 3, 3400.0),
        rec("L11", 5, 40.0, 2, None),
    ]
    assert matches(spark, left, right) == {("F1", "L1"), ("F1", "L2"), ("F2", "L5"), ("F3", "L7"), ("F4", "L9")}
    got = {(r["l"], r["r"]): r["confidence"] for r in link(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)).collect()}
    assert got["F2", "L5"] < got["F1", "L2"]


def frame(spark, rows, side="r"):
    return spark.createDataFrame(rows, SCHEMA).drop("n", "found").withColumn("side", F.lit(side))


def test_buildings_from_coordinates(spark):
    here, beside, far = dict(lat=-7.10001, lon=-36.1), dict(lat=-7.10021, lon=-36.1), dict(lat=-7.11, lon=-36.1)
    named = [
        rec("N1", 1, 60.0, 2, 1500.0, fee=310.0, **here),
        # The same dwelling's address without coordinates tells of it just as well.
        rec("N2", 1, 85.0, 3, 2500.0),
        rec("N3", 2, 60.0, 2, 1500.0, fee=280.0, **beside),
        # One vague coordinate given for many buildings.
        *[rec(f"M{i}", 10 + i, 44.0, 1, 900.0, lat=-7.30001, lon=-36.3) for i in range(120)],
    ]
    asked = [
        rec("A", None, 60.0, 2, 1500.0, **here),
        rec("B", None, 60.0, 2, 1500.0, fee=280.0, lat=-7.10011, lon=-36.1),
        rec("C", None, 85.0, 3, 2490.0, **here),
        rec("D", None, 60.0, 2, 1500.0, **far),
        rec("E", None, 44.0, 1, 900.0, lat=-7.30001, lon=-36.3),
        rec("F", None, 60.0, 2, 1500.0, lat=-7.1, lon=-36.1),
        rec("G", None, None, 2, 1500.0, **here),
        rec("H", None, 61.7, 2, 1200.0, lat=-7.1004, lon=-36.1),
    ]
    got = {r["id"]: r for r in with_buildings(frame(spark, named + asked)).collect()}
    assert len(got) == len(named + asked)
    assert {i: got[i]["building"] for i in "ABCDEFGH"} == {"A": 1, "B": 2, "C": 1, **dict.fromkeys("DEFGH")}
    assert got["N1"]["placed"] == 1.0 and 0.5 < got["A"]["placed"] < 1 and got["D"]["placed"] is None


def test_areas_from_fees_taxes_and_floors(spark):
    rows = [
        rec("A", 1, 70.0, 2, 1500.0, fee=300.0, tax=90.0),
        rec("B", 1, None, 2, 1900.0, fee=300.0),
        rec("C", 1, 90.0, 2, 1500.0, tax=90.0, floor=4),
        # What two dwellings share says nothing.
        rec("D", 1, None, 2, 1500.0, tax=90.0),
        rec("E", 1, None, 2, None, floor=4),
        rec("F", 2, None, 2, 1500.0, fee=300.0),
    ]
    got = {r["id"]: (r["area"], r["surveyed"]) for r in with_areas(frame(spark, rows).withColumn("placed", F.lit(1.0))).collect()}
    assert got == {"A": (70.0, 1.0), "B": (70.0, 0.95), "C": (90.0, 1.0), "D": (None, None), "E": (90.0, 0.95), "F": (None, None)}


def test_neighbours_rescore_every_link_until_stable(spark):
    right = [rec("L1", 1, 70.0, 2, 1500.0, fee=300.0), rec("L2", 1, 70.0, 2, 1900.0, fee=300.0), rec("L3", 1, 70.0, 2, 2500.0), rec("L4", 1, 70.0, 2, 1500.0, fee=410.0), rec("L5", 1, 90.0, 2, 3900.0, fee=410.0)]
    links = spark.createDataFrame([("F1", "L1", 0.9, True), ("F1", "L2", 0.6, True), ("F1", "L3", 0.6, True), ("F1", "L4", 0.6, True)], "l string, r string, s double, settled boolean")
    got = {r["r"]: r["s"] for r in rescored(links, spark.createDataFrame(right, SCHEMA)).collect()}
    # L2 is held up by L1 of the same fee, L3 has no neighbour, L4's neighbour has no link.
    assert got["L2"] > got["L3"] > got["L4"] and got["L3"] == pytest.approx(0.6)
    x, y = got["L1"], got["L2"]
    assert x == pytest.approx(0.7 * 0.9 + 0.3 * y, abs=1e-5) and y == pytest.approx(0.7 * 0.6 + 0.3 * x, abs=1e-5)


def test_empty(spark):
    assert matches(spark, [], []) == set()
    assert matches(spark, [rec("F1", 1, 70.0)], []) == set()


def test_p3_leaves_only_the_tables_of_its_result(spark):
    folder = Path(shared_dir(spark).removeprefix("file://"), "vitrine")
    label = lambda: {(p.name, p.name.rpartition("-")[0]) for p in folder.glob("*")}
    before = label()
    result = p3_links(spark, "/root/testdata/sf0.001")
    assert {name for _, name in label() - before} == {"fichas", "urls", "matches"}
    assert result.count() == result.select("url", "ficha_id").distinct().count() > 0
