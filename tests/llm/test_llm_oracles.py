from pathlib import Path

import pytest

from tests.oracle import agree
from vitrine.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables absent")


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_sql(spark, name):
    run, sql = QUERIES[name]
    agree(spark, run, sql, FOLDER)


@pytest.mark.parametrize(("name", "columns"), [("p3_found", ["url", "ficha_id"]), ("p7_found", ["url_a", "url_b"]), ("p9_found", ["doc_id", "item_id"]), ("p10_found", ["doc_id", "lang"])])
def test_shape_of_results(spark, name, columns):
    found = QUERIES[name][0](spark, FOLDER)
    assert found.columns == columns
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) > 0
    if name == "p7_found":
        assert all(a < b for a, b in rows)


def test_packed_texts_are_whole(spark):
    from vitrine.llm.packing import pack  # noqa: F401
    from vitrine.llm.tokens import token_counts
    from vitrine.sources.tables import table

    docs = table(spark, FOLDER, "documents")
    sizes = {r["id"]: r["size"] for r in token_counts(docs, id=docs["doc_id"], text=docs["text"]).collect()}
    got = QUERIES["p8_packed"][0](spark, FOLDER).collect()
    for janela, capacity in ((1, 512), (2, 2048), (3, 8192)):
        total, filled = {}, {}
        for r in (r for r in got if r["janela_id"] == janela):
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
            filled[(r["lote"], r["conteiner"])] = filled.get((r["lote"], r["conteiner"]), 0) + r["n_tokens"]
        assert total == sizes and max(filled.values()) <= capacity
        assert len(filled) <= sum(sizes.values()) / capacity * 1.02 + 1


def test_every_query_takes_empty_tables(spark, tmp_path):
    import pyarrow.parquet as pq

    for p in Path(FOLDER).glob("*.parquet"):
        pq.write_table(pq.read_table(p).slice(0, 0), tmp_path / p.name)
    for name, (run, _) in QUERIES.items():
        assert run(spark, str(tmp_path)).collect() == [], name
