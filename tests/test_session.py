import os
import time

import pytest
from pyspark.sql import functions as F

from vitrine import session
from vitrine.operators.arrow_groups import map_groups
from vitrine.session import CLEANUP, bounded_lookup, discard, materialize, materialize_at, settled, shared_dir


def test_lookup_is_broadcast_within_its_bound_only(spark):
    small, large = spark.range(5), spark.range(50)
    plan = lambda df: spark.range(10).join(df, "id")._jdf.queryExecution().toString()
    assert "broadcast" in plan(bounded_lookup(small, 10)).lower().split("physical")[0]
    assert bounded_lookup(large, 10) is large
    assert bounded_lookup(small.limit(0), 10).count() == 0


def test_tables_go_to_the_shared_folder(spark, tmp_path, monkeypatch):
    class Conf:
        def get(self, name, default=None):
            return f"file://{tmp_path}/" if name == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert shared_dir(Session()) == f"file://{tmp_path}"
    out, path = materialize_at(spark.range(3), "x")
    assert out.count() == 3 and path.startswith(shared_dir(spark))
    folder = path.removeprefix("file://")
    assert os.path.isdir(folder)
    discard(spark, path)
    assert not os.path.exists(folder)
    assert session.shared_dir(spark) == session.shared_dir(spark)


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(n).getName() for n in range(files.size())]
    return {n for n in names if n.startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    before, was = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    table = spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("g")).count()
    out, path = materialize_at(table, "x")
    for _ in range(100):  # they are deleted in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(CLEANUP, None) == was
    assert out.count() == 7
    discard(spark, path)


def test_settled_keeps_only_its_own_table(spark):
    paths = []

    def make():
        one, path = materialize_at(spark.range(3), "one")
        paths.append(path)
        return settled(lambda: materialize(one, "inner"), "two").union(one)

    out = settled(make, "three")
    folder = os.path.dirname(paths[0].removeprefix("file://"))
    assert out.count() == 6
    assert not [n for n in os.listdir(folder) if n.split("-")[0] in ("one", "inner", "two")]


def test_groups_cross_batches(spark):
    import pyarrow as pa

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(200).selectExpr("case when id % 5 = 4 then null else id % 5 end as g", "id")

        def total(t):
            yield pa.RecordBatch.from_arrays([pa.array([t.column("g")[0].as_py()], pa.int64()), pa.array([t.num_rows]), pa.array([t.column("id").to_pylist() == sorted(t.column("id").to_pylist())])], names=["g", "n", "ordered"])

        got = map_groups(df, ["g"], ["id"], total, "g bigint, n bigint, ordered boolean").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["g"] is None, r["g"], r["n"], r["ordered"]) for r in got if r["g"] is not None) == [(False, g, 40, True) for g in range(4)]
    assert [(r["n"], r["ordered"]) for r in got if r["g"] is None] == [(40, True)]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from vitrine.session import shared_dir

    def session(**conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d)))

    assert shared_dir(session(spark_checkpoint_dir="hdfs:///x/", spark_master="yarn")) == "hdfs:///x"
    assert shared_dir(session(spark_master="local[4]")).startswith("file://")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,512]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(spark_master=master))


def test_only_an_absent_subpackage_is_passed_over(monkeypatch):
    import __spark_entry__ as e

    def fails(missing):
        def load(name):
            raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)

        return load

    monkeypatch.setattr(e.importlib, "import_module", fails("vitrine.llm"))
    monkeypatch.setattr(e, "registry", dict)
    assert e.queries() == {}
    monkeypatch.setattr(e.importlib, "import_module", fails("tokenizers"))
    with pytest.raises(ModuleNotFoundError):
        e.queries()
