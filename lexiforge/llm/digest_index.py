"""Exact de-duplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the digest of the normalised text (A-Z lower-cased,
null counts as empty). New rows are digested, grouped, held against the index by a sort-merge anti-join
and the digests that are new are appended. The join with the index needs no exchange of the index.

Defined results: null text equals the empty text; a null id is the smallest id; rows that repeat an id and
its text are separate rows of which one stays; an empty batch appends nothing and returns no rows; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


class DigestIndex:
    """A bucketed, sorted table of (digest, keep_id) at a path; opening a path again continues it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 48, id_type: str = "bigint"):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest STRING, keep_id {id_type}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
        )

    def frame(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame) -> None:
        """One file for each bucket and append: the rows are dealt by the buckets' own hash.

        Running an append again after a failure adds nothing twice, for the anti-join has dropped what is there.
        """
        fresh.select("digest", "keep_id").repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def close(self) -> None:
        """Forget the table's name; the files stay at the path."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256; appends new digests to index.

    Of equal texts the row with the largest id stays, unless the index already holds the text: then none of
    this batch stays and keep_id is the id that the index has. group_size counts the rows of this batch.
    """
    spark = docs.sparkSession
    rows = materialise(
        spark,
        docs.select(F.col(id_col).alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("digest")).withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )
    groups = rows.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("top"), F.count("*").alias("group_size"))
    groups = groups.select("digest", F.col("top.id").alias("keep_id"), F.col("top.row").alias("keep_row"), "group_size")
    old = index.frame().select("digest", F.col("keep_id").alias("old_id"))
    fresh = materialise(spark, groups.join(old.hint("merge"), "digest", "left_anti"), "fresh-digests")
    known = groups.join(old.hint("merge"), "digest").select("digest", F.col("old_id").alias("keep_id"), F.lit(None).cast("long").alias("keep_row"), "group_size")
    verdict = materialise(spark, fresh.unionByName(known), "digest-verdicts")
    index.append(fresh)
    out = rows.join(verdict, "digest")
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256"),
    )
