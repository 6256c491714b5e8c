from pathlib import Path

import pytest

from tests.oracle import agree
from vitrine.queries import registry

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables absent")


@pytest.mark.parametrize("name", [n for n, (_, sql) in registry().items() if sql])
def test_query_equals_sql(spark, name):
    run, sql = registry()[name]
    agree(spark, run, sql, FOLDER)


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"p1_found", "p2_found", "p5_found"} <= set(e.queries())


def test_every_query_takes_empty_tables(spark, tmp_path):
    import pyarrow.parquet as pq

    for p in Path(FOLDER).glob("*.parquet"):
        pq.write_table(pq.read_table(p).slice(0, 0), tmp_path / p.name)
    for name, (run, _) in registry().items():
        # One row says how many there are of nothing.
        assert len(run(spark, str(tmp_path)).collect()) <= 1, name
