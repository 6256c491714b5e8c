from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vitrine.operators import bookkeeping as b
from vitrine.operators import tables
from vitrine.sources.registry import collected


def test_runs_open_and_close(spark):
    runs = spark.createDataFrame([(1, datetime(2026, 1, 1), None, "EM_ANDAMENTO", "x")], "id bigint, iniciada_em timestamp, encerrada_em timestamp, status string, versao_codigo string")
    after = b.closed(b.opened(runs, run=2, at="2026-01-02 05:00:00", version="abc"), run=1, at="2026-01-01 06:00:00", status="OK")
    got = {r["id"]: (r["status"], r["versao_codigo"], str(r["encerrada_em"])) for r in after.collect()}
    assert got == {1: ("OK", "x", "2026-01-01 06:00:00"), 2: ("EM_ANDAMENTO", "abc", "None")}


def test_rows_of_a_key_are_replaced(spark):
    stored = spark.createDataFrame([(1, "a", 5), (1, "b", 6)], "run int, fonte string, n int")
    batch = spark.createDataFrame([(7, "a", 1), (8, "c", 1)], "n int, fonte string, run int")
    assert sorted(tuple(r) for r in b.replaced(stored, batch, keys=["run", "fonte"]).collect()) == [(1, "a", 7), (1, "b", 6), (1, "c", 8)]


def test_galleries(spark):
    dwellings = spark.createDataFrame([(1, ["a"]), (2, ["a"] * 5), (3, None)], "id int, fotos array<string>")
    offers = spark.createDataFrame([(1, "u1", 3), (1, "u2", 1), (1, "u3", 2), (2, "u4", 1), (3, "u5", 1), (4, "u6", 1)], "id int, url string, o int")
    assert sorted(tuple(r) for r in b.gallery_candidates(dwellings, offers, entity="id", photos="fotos", url="url", order=["o"]).collect()) == [(1, "u2"), (1, "u3"), (3, "u5")]
    found = spark.createDataFrame([("u1", ["x", "y"]), ("u2", ["x", "y", "z"]), ("u4", ["x"]), ("u5", [])], "url string, fotos array<string>")
    got = {r["id"]: r["fotos"] for r in b.grown_galleries(dwellings, offers, found, entity="id", photos="fotos", url="url").collect()}
    assert got == {1: ["x", "y", "z"], 2: ["a"] * 5, 3: None}


def test_marks_of_dwellings_and_due_hosts(spark):
    offers = spark.createDataFrame([(1, "u1"), (1, "u2"), (2, "u3"), (3, None)], "id int, url string")
    got = b.entity_marks(spark.createDataFrame([(1,), (2,), (3,)], "id int"), offers, spark.createDataFrame([("u2",), (None,)], "url string"), entity="id", url="url")
    assert {r["id"]: r["marcado"] for r in got.collect()} == {1: True, 2: False, 3: False}
    hosts = spark.createDataFrame([("a",), ("b",), ("c",)], "host string")
    cache = spark.createDataFrame([("a", datetime(2026, 5, 1)), ("a", datetime(2026, 1, 1)), ("b", datetime(2026, 4, 1))], "host string, at timestamp")
    assert sorted(r["host"] for r in b.due_hosts(hosts, cache, host="host", at="at", today="2026-05-20").collect()) == ["b", "c"]


def test_bars_of_nothing(spark):
    rows = spark.createDataFrame([("a", 0, 0, 30), ("b", 0, 0, 5)], "site string, useful int, exclusive int, seconds int")
    got = {r["site"]: (r["useful_bar"], r["wasted"], r["warning"]) for r in b.yield_bars(rows).collect()}
    assert got == {"a": (2, 35.0, True), "b": (2, 35.0, False)} and b.yield_bars(rows.limit(0)).count() == 0


def test_badges_restricted_to_preferred_rows(spark):
    rows = spark.createDataFrame([(i, float(i), i % 2 == 0) for i in range(6)], "id int, x double, p boolean")
    run = lambda **how: sorted(r["id"] for r in tables.affinity(rows, ranges={"custo": ("x", 1.0, True)}, flags={}, penalty=F.lit(1.0), eligible=F.col("id") > 0, ties=["id"], **how).where("badge").collect())
    assert run() == [1] and run(preferred=F.col("p")) == [2, 4]


def test_sources_are_read_by_type(spark):
    sources = spark.createDataFrame([("s1", "a"), ("s2", "b"), ("s3", "revisar"), ("s4", None)], "site string, tipo string")
    pages = spark.createDataFrame([("s1", "x"), ("s2", "y"), ("s3", "z")], "site string, html string")
    readers = {"a": lambda p: p.select("site", F.upper("html").alias("t")), "b": lambda p: p.select("site", F.lit(1).alias("n"))}
    assert sorted((r["site"], r["t"], r["n"]) for r in collected(sources, pages, readers).collect()) == [("s1", "X", None), ("s2", None, 1)]
    with pytest.raises(ValueError):
        collected(sources, pages, {"a": readers["a"]})
