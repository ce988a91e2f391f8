"""Session settings shared by tests, bench and local runs."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "techatlas") -> SparkSession:
    """A local session. On a cluster the caller passes its own session instead."""
    n = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared checkpoint folder of the session.

    The cluster names the folder in ``spark.checkpoint.dir``. Only where that is unset (a
    local test session) a temporary folder is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="techatlas-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Folders that ``materialize`` wrote and ``release`` has not removed.
_written: list[str] = []


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme Spark would read it by, so that Python tasks open the same place."""
    target, files = _hadoop(spark, path)
    return files.makeQualified(target).toString()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system it lies."""
    target, files = _hadoop(spark, path)
    files.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system."""
    target, files = _hadoop(spark, path)
    return files.exists(target)


def release(spark: SparkSession) -> None:
    """Delete all intermediate results; to be called when no DataFrame built on them is needed any more."""
    while _written:
        remove(spark, _written.pop())


def discard(df: DataFrame) -> None:
    """Delete the files of one intermediate result, given as ``materialize`` returned it, before the others."""
    spark = df.sparkSession
    files = df.inputFiles()
    # folder names are unique, however a file system writes the way to them
    for path in [p for p in _written if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in files)]:
        remove(spark, path)
        _written.remove(path)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Inside, a job's shuffle files go when it ends; for chains of jobs that each write their result."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, purpose: str, by: str | None = None, **options: str) -> DataFrame:
    """Write an intermediate result below the shared folder and go on from the files.

    For results used several times: they are computed once, survive lost executors, and the
    plans built on them stay small. ``by``: a column whose values get a folder each; ``options``: of the Parquet writer.
    """
    path = shared_dir(df.sparkSession, purpose)
    out = df.write.options(**options)
    (out.partitionBy(by) if by else out).parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
