"""Session construction and cluster-safe lineage cutting."""

from __future__ import annotations

import os
import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "reposcope") -> SparkSession:
    """Local/test session. On a cluster the platform builds the session; the
    library only reads its settings."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster
    (``spark.checkpoint.dir``). Only when none is configured (local tests) a
    scratch folder is created and registered."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="reposcope-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


#: folders of the tables stored by this thread within each open ``scratch``
_OPEN = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread stores within go when the block ends, and the
    shuffle files of each job with it. What is made of them must be written by
    then."""
    stack = _OPEN.__dict__.setdefault("stack", [])
    stack.append(paths := [])
    cleans = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleans, "false")
    spark.conf.set(cleans, "true")
    try:
        yield
    finally:
        spark.conf.set(cleans, before)
        stack.pop()
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(table: DataFrame, part: str = "") -> None:
    """Deletes a ``stored`` table, or a part of it as ``by`` cut it, that nothing reads any more."""
    _delete(table.sparkSession, f"{table.stored_at}/{part}".rstrip("/"))


def stored(df: DataFrame, name: str, *by: str, codec: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read back:
    later scans prune columns, and a lost executor costs no recomputation.
    A filter on the columns ``by`` reads the files that it lets through alone.
    ``codec`` is for texts that lie long: the planner takes a table's size from its files."""
    import uuid

    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for paths in _OPEN.__dict__.get("stack", [])[-1:]:
        paths.append(path)
    df.write.partitionBy(*by).parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def exploded(df: DataFrame, items: Column, name: str, *keep: str) -> DataFrame:
    """``keep`` and a row per item of an array without nulls. A plain explode
    makes the planner filter on the array's size and null first, so that an
    array made from a text would be made three times."""
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def merged(df: DataFrame) -> DataFrame:
    """A join side that grows with the corpus: it is sorted and merged. Left to
    the planner, its size is guessed from compressed files, which repeated
    values make a hundred times smaller than the rows, and the table is
    broadcast, that is, passes whole through the driver."""
    return df.hint("merge")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor
    loss, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
