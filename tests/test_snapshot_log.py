from datetime import datetime

from vitrine.queries import registry

T = lambda d, h=5: datetime(2026, 1, d, h)


def folder(spark, tmp_path):
    """Runs 7, 5, 9, 8 in this order, 6 without a snapshot."""
    rows = [
        (7, "a", "t", 10.0, 1, T(1)), (5, "a", "t", 12.0, 1, T(2)), (9, "a", "t", 10.0, 1, T(3)), (8, "a", "t", 10.0, 1, T(4)),
        (5, "b", "t", 20.0, 1, T(2)),
        (7, "c", "t", 30.0, 1, T(1)), (5, "c", "t", 30.0, 0, T(2)), (9, "c", "t", 30.0, 1, T(3)), (8, "c", "u", 31.0, 1, T(4)), (8, "c", "t", 99.0, 1, T(4, 4)),
    ]
    rows = [(r, f"https://x.com/{k}", *rest) for r, k, *rest in rows]
    spark.createDataFrame(rows, "execucao_id bigint, url string, titulo string, preco double, visto_na_ultima_execucao int, entregue_em timestamp").write.parquet(f"{tmp_path}/imoveis_snapshot.parquet")
    spark.createDataFrame([(7, T(1)), (5, T(2)), (6, T(2, 9)), (9, T(3)), (8, T(4))], "id bigint, iniciada_em timestamp").write.parquet(f"{tmp_path}/execucao.parquet")
    return str(tmp_path)


def found(spark, name, at):
    return sorted((r.asDict().get("execucao_id", 0), r["key"][-1], r["kind"], r["delta"]) for r in registry()[name][0](spark, at).collect())


def test_events_between_all_snapshots(spark, tmp_path):
    assert found(spark, "snapshot_event_log", folder(spark, tmp_path)) == [
        (5, "a", "PRECO_ALTERADO", 2.0), (5, "b", "CRIADO", None), (5, "c", "SUMIU", None),
        (8, "c", "DESCRICAO_ALTERADA", None), (8, "c", "PRECO_ALTERADO", 1.0),
        (9, "a", "PRECO_ALTERADO", -2.0), (9, "b", "SUMIU", None), (9, "c", "REAPARECEU", None),
    ]


def test_first_and_last_snapshot_are_taken_from_the_data(spark, tmp_path):
    assert found(spark, "snapshot_events", folder(spark, tmp_path)) == [(0, "c", "DESCRICAO_ALTERADA", None), (0, "c", "PRECO_ALTERADO", 1.0)]
