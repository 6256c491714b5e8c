"""Comparison of a query with its SQL on the same tables."""

from pathlib import Path

import duckdb


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, list):
        return tuple(map(norm, v))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(norm(r[i]) for i in order)) for r in data), [columns[i] for i in order]


def agree(spark, run, sql, folder):
    df = run(spark, folder)
    got = rows(df.columns, df.collect())
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    found = con.execute(sql)
    want = rows([d[0] for d in found.description], found.fetchall())
    assert got[1] == want[1]
    assert got[0] == want[0]
