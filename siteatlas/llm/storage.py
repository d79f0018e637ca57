"""Tables that cut lineage, kept in the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where it is unset and the master is local."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="siteatlas-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/siteatlas/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def durable(df: DataFrame, label: str) -> DataFrame:
    """df written once and read again: whatever is lost later is read back, never computed anew."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope() -> Iterator[list[str]]:
    """The paths of the tables that are written inside, for release()."""
    global _written
    outer, _written = _written, []
    try:
        yield _written
    finally:
        outer += _written
        _written = outer


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete these tables; only for when all results built on them are stored elsewhere."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the executions inside go when each ends: for results that aren't computed twice."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tune(spark: SparkSession) -> None:
    """Bounded Arrow batches, so that very long texts don't meet in one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
