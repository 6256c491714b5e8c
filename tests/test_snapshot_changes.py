from datetime import datetime

from pyspark.sql import functions as F

from vitrine.operators.snapshot_changes import delivered_runs, snapshot_changes, validity_intervals

T = lambda d, h=6: datetime(2026, 1, d, h)
def how():
    return dict(key=F.col("k"), arrived="at", present=F.col("seen") == 1, texts={"t": F.lower("t")}, numbers={"p": F.col("p"), "q": F.col("q")})


SCHEMA = "run bigint, k string, t string, p double, q int, seen int, at timestamp, seq string, row string"


def runs(spark, ids=(1, 2, 3, 4)):
    return spark.createDataFrame([(i, T(i)) for i in ids], "id bigint, started timestamp")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def changes(spark, rows, ids=(1, 2, 3, 4)):
    found = snapshot_changes(frame(spark, rows), runs(spark, ids), run_id="run", runs_id="id", runs_order="started", **how())
    return sorted(map(tuple, found.collect()))


def test_added_removed_changed(spark):
    rows = [(1, "a", "T", 10.0, 2, 1, T(1)), (2, "a", "t", 10.004, 2, 1, T(2)), (3, "a", "t", 10.02, 2, 1, T(3)), (3, "b", "n", 5.0, 1, 1, T(3)), (4, "a", "t", 10.02, 2, 0, T(4)), (4, "b", "n", 5.0, None, 1, T(4))]
    assert changes(spark, rows) == [(3, "a", "ALTERADO"), (3, "b", "ADICIONADO"), (4, "a", "REMOVIDO"), (4, "b", "ALTERADO")]


def test_gap_and_return_and_runs_that_delivered_nothing(spark):
    rows = [(1, "a", "t", 1.0, 1, 1, T(1)), (1, "b", "t", 1.0, 1, 1, T(1)), (3, "b", "t", 1.0, 1, 1, T(3)), (4, "a", "t", 1.0, 1, 1, T(4)), (4, "b", "t", 1.0, 1, 1, T(4))]
    # Run 2 delivered nothing: 1 and 3 are neighbours.
    assert changes(spark, rows) == [(3, "a", "REMOVIDO"), (4, "a", "ADICIONADO")]


def test_latest_row_speaks_and_ties_are_settled(spark):
    rows = [(1, "a", "t", 1.0, 1, 1, T(1)), (2, "a", "t", 9.0, 1, 1, T(2, 5)), (2, "a", "t", 1.0, 1, 1, T(2, 7)), (2, "a", "t", 1.0, 1, 1, T(2, 7)), (3, "a", "t", 1.0, 1, 1, T(3)), (3, "a", "t", 2.0, 1, 1, T(3))]
    assert changes(spark, rows) == [(3, "a", "ALTERADO")]


def test_nulls_nan_unknown_runs_and_empty(spark):
    rows = [(1, "a", None, None, None, 1, None), (2, "a", None, float("nan"), None, 1, T(2)), (2, None, "t", 1.0, 1, 1, T(2)), (None, "a", "t", 1.0, 1, 1, T(2)), (9, "z", "t", 1.0, 1, 1, T(2)), (3, "a", None, None, None, None, T(3))]
    assert changes(spark, rows) == [(3, "a", "REMOVIDO")]
    assert changes(spark, []) == []


def test_intervals(spark):
    rows = frame(spark, [(i, "a", "t", 1.0 if i < 3 else 2.0, 1, 1, T(i)) for i in (1, 2, 3, 4)])
    seqs = delivered_runs(rows, runs(spark), "run", "id", "started")
    found = validity_intervals(rows, seqs, run_id="run", **how())
    assert sorted((r["first"], r["last"]) for r in found.collect()) == [(1, 2), (3, 4)]
