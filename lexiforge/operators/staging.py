"""Tables written once to the shared folder where several branches of a plan need them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only for a session in one process that has no such setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="lexiforge-"))
    return _LOCAL[0]


def staged(df: DataFrame) -> DataFrame:
    """df, computed and written as Parquet below the shared folder, so that branches read the columns they need and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lexiforge-staged/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(spark: SparkSession) -> int:
    """Delete all that ``staged`` has written in this process, once no plan reads it any more; gives the number of tables."""
    n = 0
    while _WRITTEN:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True))
    return n
