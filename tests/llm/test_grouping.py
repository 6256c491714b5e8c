import random
from datetime import datetime

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitrine.llm.components import connected_components, star_edges
from vitrine.llm.packing import first_fit_decreasing, pack
from vitrine.llm.survivorship import latest_offers, surviving_values, usable_amount, usable_text

T = lambda d: datetime(2026, 1, d)


def roots(edges, vertices):
    parent = {v: v for v in vertices}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in vertices}


def components(spark, edges, vertices):
    found = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), spark.createDataFrame([(v,) for v in vertices], "v bigint")).collect()
    assert len(found) == len({r["v"] for r in found})
    return {r["v"]: r["label"] for r in found}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components_against_union_find(spark, edges):
    vertices = list(range(-2, 26))
    assert components(spark, edges, vertices) == roots(edges, vertices)


def test_giant_chain_nulls_and_empty(spark):
    hub = [(100, i) for i in range(101, 160)] + [(159, 7)]
    chain = [(i, i + 1) for i in range(1000, 1060)]
    vertices = [5, 7, *range(100, 160), *range(1000, 1061)]
    edges = [*hub, *chain, (5, 5), *hub]
    assert components(spark, [*edges, (None, 3), (4, None)], vertices) == roots([(a, b) for a, b in edges], vertices)
    assert components(spark, [], []) == {}
    assert components(spark, [], [3]) == {3: 3}


def test_long_chain_takes_few_tables(spark, monkeypatch):
    from vitrine.llm import components as module

    written = []
    monkeypatch.setattr(module, "materialize_at", lambda df, label, f=module.materialize_at: written.append(label) or f(df, label))
    ids = list(range(20_000))
    random.Random(1).shuffle(ids)
    chain = list(zip(ids, ids[1:], strict=False))
    bush = [(100_000 + i // 3, 100_000 + i) for i in range(1, 3_000)]
    got = components(spark, chain + bush, [])
    assert {got[i] for i in ids} == {0} and {got[100_000 + i] for i in range(3_000)} == {100_000}
    assert len(written) < 60


def test_star_edges_stand_for_all_pairs(spark):
    rows = [("h", 3), ("h", 1), ("h", 2), ("h", 2), ("g", 9), (None, 4), ("h", None)]
    got = star_edges(spark.createDataFrame(rows, "hub string, m bigint"), hub="hub", member="m").collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(1, 2), (1, 3)]


@given(st.lists(st.integers(0, 20), max_size=60), st.integers(20, 30))
def test_tournament_tree_equals_plain_first_fit(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    free, want = [], []
    for s in sizes:
        for n, f in enumerate(free):
            if f >= s:
                break
        else:
            free.append(capacity)
            n = len(free) - 1
        free[n] -= s
        want.append(n)
    assert first_fit_decreasing(np.array(sizes, dtype=np.int64), capacity).tolist() == want


def test_packing_is_an_exact_round_trip(spark):
    items = [(i, s) for i, s in enumerate([0, 5, 10, 11, 25, 40, 3, 3, None, 7] * 20)] + [(None, 5), (3, 4)]
    df = spark.createDataFrame([(*r, "x", 1) for r in items], "id bigint, size bigint, bin string, capacity int")
    boxes = spark.createDataFrame([(1, 10), (2, 25), (3, 0), (None, 4)], "container int, capacity int")
    got = pack(df, boxes, group_pieces=60).collect()
    for container, capacity in ((1, 10), (2, 25)):
        rows = [r for r in got if r["container"] == container]
        filled, covered = {}, {}
        for r in rows:
            filled[(r["cell"], r["bin"])] = filled.get((r["cell"], r["bin"]), 0) + r["size"]
            covered[r["id"]] = covered.get(r["id"], 0) + r["size"]
        assert max(filled.values()) <= capacity
        want = {}
        for i, s in items:
            if i is not None:
                want[i] = want.get(i, 0) + (s or 0)
        assert covered == want
        cut = [r for r in rows if dict((i, s or 0) for i, s in items if i is not None and i != 3).get(r["id"], 0) <= capacity and r["id"] != 3]
        assert all(r["piece"] == 0 for r in cut)
        assert len(filled) <= 1.3 * sum(want.values()) / capacity + 4
    assert {r["container"] for r in got} == {1, 2}
    assert pack(df.limit(0), boxes).count() == 0


def test_usable_values(spark):
    def one(make, text):
        return spark.createDataFrame([(text,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]

    for text, want in [("R$ 2.945,00/mês", 2945.0), ("2650.5", 2650.5), ("R$4.105", 4105.0), ("102500.0", 102500.0), ("99,9m2", 99.9), ("0,00", None), ("consulte", None), ("", None), (None, None), ("R$ 1.234.567,89 mensais", 1234567.89)]:
        assert one(usable_amount, text) == want, text
    for text, want in [("  Parque  dos Ipês ", "parque dos ipes"), ("N/D", None), ("0,00", None), (" ", None), ("Não informado", None)]:
        assert one(usable_text, text) == want, text


def survivors(spark, rows, trust):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "g bigint, f string, v map<string,string>, c string, at timestamp, trust string, entries string")
    latest = latest_offers(df, group="g", field="f", values="v", chosen="c", at="at")
    t = spark.createDataFrame(trust, "source string, trust double")
    return {(r["group_id"], r["field"]): r["value"] for r in surviving_values(latest, t, ["bairro"]).collect()}


def test_survivorship(spark):
    trust = [("a", 0.5), ("b", 0.9), ("c", 0.7)]
    rows = [
        (1, "preco", {"A": "R$ 10,00", "B": "12", "C": "10.0"}, "x", T(2)),
        (1, "preco", {"A": "99"}, "x", T(1)),
        (2, "preco", {"A": "10", "B": "12"}, "x", T(1)),
        (3, "preco", {"A": "0", "B": "consulte"}, "x", T(1)),
        (4, "bairro", {"A": "Água Fria", "B": "agua  fria", "C": "Centro"}, "x", T(1)),
        (5, "preco", {"A": "10", " a ": "10", "B": "12", "z": "12"}, "x", T(1)),
        (6, "preco", {}, None, T(1)),
        (7, "preco", None, None, None),
        (None, "preco", {"A": "1"}, "x", T(1)),
        (2, "preco", {"A": "10", "B": "12"}, "x", T(1)),
    ]
    assert survivors(spark, rows, trust) == {(1, "preco"): "10.00", (2, "preco"): "12.00", (3, "preco"): None, (4, "bairro"): "agua fria", (5, "preco"): "12.00", (6, "preco"): None, (7, "preco"): None}
    assert survivors(spark, [], trust) == {}
