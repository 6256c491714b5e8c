"""Session construction, shared scratch tables and size-checked broadcasts.

Everything that cuts lineage goes through :func:`materialize`, which writes a
Parquet table below the folder named by ``spark.checkpoint.dir``; executors can
be lost at any time without losing an intermediate result. The shuffle files of
a table go as soon as it is written; :func:`settled` also deletes the tables
that only led to another.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup table may be sent to every executor.
LOOKUP_ROWS = 100_000

#: Whether Spark deletes the shuffle files of an execution at its end, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_OWN_DIR: list[str] = []
#: Paths of the tables written within the innermost :func:`settled`.
_WITHIN: ContextVar[list[str] | None] = ContextVar("_WITHIN", default=None)


def build_session(app: str = "vitrine", cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A local session with the settings the operators are written for."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, or a folder of our own where none is set and everything runs in one process (tests).

    On a cluster without the setting this is an error: a machine's own folder
    would hold only what its own executors wrote.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a shared folder (master {master!r})")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="vitrine-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
    return "file://" + _OWN_DIR[0]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back."""
    return materialize_at(df, label)[0]


@contextmanager
def _without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Executions within leave no shuffle files; outside all is as it was set."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As :func:`materialize`, with the path, for :func:`discard`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vitrine/{label}-{uuid.uuid4().hex}"
    with _without_shuffle_files(spark):
        df.write.parquet(path)
    within = _WITHIN.get()
    if within is not None:
        within.append(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)  # results read it until the session ends
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`materialize_at` that nothing reads any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The table ``make()`` gives, written; the tables that ``make`` wrote on the way are deleted, so no other result may read them."""
    own: list[str] = []
    token = _WITHIN.set(own)
    try:
        df = make()
    finally:
        _WITHIN.reset(token)
    out = materialize(df, label)
    for path in own:
        discard(df.sparkSession, path)
    return out


def bounded_lookup(df: DataFrame, max_rows: int = LOOKUP_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, else ``df`` as it is.

    The bound is verified by fetching at most ``max_rows + 1`` rows; beyond it
    the caller's join falls back to a shuffled join.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
