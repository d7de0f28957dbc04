"""Shared helpers: work folders on storage that every executor sees, and cutting lineage there."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only for an unset local session."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = tempfile.mkdtemp(prefix="lexiforge-")
    return _LOCAL


_LOCAL: str | None = None


def workspace(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; nothing is created yet."""
    return f"{shared_root(spark)}/lexiforge/{label}-{uuid.uuid4().hex}"


def materialise(spark: SparkSession, df: DataFrame, label: str, by: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """Write df as Parquet (with a codec other than the session's) in the shared folder and read it back: the lineage ends there."""
    path = workspace(spark, label)
    writer = df.write
    if by:
        writer = writer.partitionBy(*by)
    if codec:
        writer = writer.option("compression", codec)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialise wrote for df, once nothing reads it any more."""
    remove(df.sparkSession, df.written_at)


def trim() -> None:
    """Give a Python worker's freed memory back to the system where the C library can; workers live on between tasks."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs that run inside hand at most this many rows at once to a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(spark: SparkSession) -> None:
    """Let the driver's JVM collect garbage: Spark then deletes the shuffle files of finished work that nothing refers to.

    The last query is referred to until another has run, so a query of one row runs first. Deletion is Spark's own and
    asynchronous; the next step begins a moment later.
    """
    spark.range(1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's (FileSystem, Path class) for path; works for any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def remove(spark: SparkSession, path: str) -> None:
    fs, make = filesystem(spark, path)
    fs.delete(make(path), True)


def total_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column, one aggregate row."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"])


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the id as text modulo folds; -1 where the id is null, so a null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds, F.lit(-1)).cast("int")


def to_worker(column: str) -> Column:
    """An id as text, for pandas turns a whole-number column with a null into floats, which round ids above 2^53."""
    return F.col(column).cast("string")


def from_worker(column: str, kind: str) -> Column:
    """An id that came back from a worker in its own type."""
    return F.col(column).cast(kind)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores in front as df's columns make necessary."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
