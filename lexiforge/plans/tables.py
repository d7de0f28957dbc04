"""The driver's tables as the queries read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns (doc_id, text if none are named) of the documents table.

    A table of fewer splits than the cluster has cores is dealt by doc_id; a larger one is left as it is stored.
    """
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))
    cores = spark.sparkContext.defaultParallelism
    return d.repartition(cores, "doc_id") if d.rdd.getNumPartitions() < cores else d
