from datetime import date, datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitrine.operators.attribute_history import observations, versions

D0 = date(2026, 1, 1)
OBS = "entity string, day date, value double, at timestamp, o string, position int"
BOUNDS = "entity string, since date, until date"


def run(spark, rows, bounds):
    seen = observations(spark.createDataFrame([(*r, "x", 0) for r in rows], OBS), entity=F.col("entity"), day=F.col("day"), value=F.col("value"), recorded=F.col("at"))
    found = versions(seen, spark.createDataFrame(bounds, BOUNDS)).collect()
    return sorted((r["entity"], (r["valid_from"] - D0).days, (r["valid_to"] - D0).days, round(r["value"], 2)) for r in found)


def brute(rows, bounds):
    out = []
    for e, since, until in bounds:
        days = {}
        for k, day, v, at in rows:
            if k == e and day and v and v > 0 and since <= day <= until and (day not in days or (at, v) > days[day]):
                days[day] = (at, v)
        prev, starts = None, []
        for day in sorted(days):
            if prev is None or round(abs(days[day][1] - prev), 9) >= 0.01:
                starts.append((day, days[day][1]))
            prev = days[day][1]
        for n, (day, v) in enumerate(starts):
            end = starts[n + 1][0] - timedelta(days=1) if n + 1 < len(starts) else until
            out.append((e, (day - D0).days, (end - D0).days, round(v, 2)))
    return sorted(out)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 40), st.sampled_from([0.0, -1.0, 5.0, 5.004, 5.02, 7.0, None]), st.integers(0, 3)), max_size=60))
def test_against_brute_force(spark, cells):
    rows = [(e, D0 + timedelta(days=d), v, datetime(2026, 1, 1) + timedelta(days=d, hours=h)) for e, d, v, h in cells]
    bounds = [("a", D0 + timedelta(days=3), D0 + timedelta(days=35)), ("b", D0, D0), ("c", D0, D0 + timedelta(days=40)), ("none", D0, D0)]
    assert run(spark, rows, bounds) == brute(rows, bounds)


def test_return_to_an_old_price_and_nulls(spark):
    at = datetime(2026, 1, 1)
    rows = [("a", D0, 1.0, at), ("a", D0 + timedelta(days=1), 2.0, at), ("a", D0 + timedelta(days=4), 1.0, at), (None, D0, 1.0, at), ("a", None, 9.0, at), ("a", D0, float("nan"), None), ("zz", D0, 1.0, at)]
    assert run(spark, rows, [("a", D0, D0 + timedelta(days=9))]) == [("a", 0, 0, 1.0), ("a", 1, 3, 2.0), ("a", 4, 9, 1.0)]
    assert run(spark, [], [("a", D0, D0)]) == []
    assert run(spark, rows, []) == []
