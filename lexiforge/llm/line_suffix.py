"""Line de-duplication by a suffix array over line ids, in DataFrame operations alone.

The corpus is a sequence of line ids, cut at documents. Distributed prefix doubling ranks the suffixes: the
rank of depth 2d is the rank of depth d refined by the rank of the suffix d lines on (within a class of equal
ranks: the number of members whose continuation sorts lower, from pre-aggregated counts of the continuations).
An LCP interval of depth n is the set of suffixes that share n lines; with 2^k <= n its identity is
(n, rank of depth 2^k at the start, rank of depth 2^k at n - 2^k lines on). A run of lines repeats if it has
at least ``min_words`` words and its interval has an earlier suffix. As every run of that many words is the union of the
windows in it that have min_words words and lose them without their first or last line, the windows' intervals
reveal all maximal runs, and ranks up to depth min_words decide them, however long the runs are. Lines that
occur once break runs and leave the work after the first count.

The earliest copy stays (by id, nulls first, then position); lines of later copies go, with the blank lines
between them. Words of a line are its stretches without white space, one for each 24 signs of a longer stretch, so that
a script without spaces has words too.

Defined results: null text counts as empty; blank lines are no part of runs; rows that repeat both id and
text are one document and are cleaned alike; rows with one id and different texts are different documents;
an empty table gives no rows; other columns pass through ``clean`` as they are, whatever their names, but for
columns named lines_deleted and all_deleted, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiforge.llm.common import materialise

_KEY = ["_d", "_h"]
#: A word of a line; and what a line that is not blank has.
WORD, SIGN = r"[^ \t\n\x0B\f\r]{1,24}", r"[^ \t\n\x0B\f\r]"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_d, _h (the document), _text, and _row, all other columns of docs as one."""
    rest = F.struct(*[docs[c] for c in docs.columns if c.lower() != text_col.lower()])
    return docs.select(F.col(id_col).alias("_d"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"), F.col(text_col).alias("_text"), rest.alias("_row"))


def line_sequence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_d, _h (the document), idx (among lines that are not blank), pos (among all), words, two hashes of the line."""
    lines = F.split(F.coalesce(F.col("_text"), F.lit("")), "\n", -1)
    placed = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("pos"), x.alias("line"))), lambda s: s["line"].rlike(SIGN))
    rows = _keyed(docs, id_col, text_col).select(*_KEY, F.posexplode(placed).alias("idx", "at"))
    line = F.col("at.line")
    words = F.regexp_count(line, F.lit(WORD))
    return rows.select(*_KEY, "idx", F.col("at.pos").alias("pos"), words.alias("words"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"))


def line_ranks(lines: DataFrame) -> DataFrame:
    """h1, h2, r0 of each line that occurs more than once: the number of positions whose line sorts before it.

    Prefix sums run within 4096 ranges of the hash, over the sums of the ranges (4096 rows at most).
    """
    counts = materialise(lines.sparkSession, lines.groupBy("h1", "h2").agg(F.count("*").alias("c")).filter("c > 1").withColumn("b", F.shiftright("h1", 52)), "line-counts")
    base = counts.groupBy("b").agg(F.sum("c").alias("s"))
    base = base.select("b", (F.sum("s").over(Window.orderBy("b")) - F.col("s")).alias("before"))
    inside = F.sum("c").over(Window.partitionBy("b").orderBy("h1", "h2")) - F.col("c")
    return counts.withColumn("i", inside).join(F.broadcast(base), "b").select("h1", "h2", (F.col("before") + F.col("i")).alias("r0"))


def deepen(t: DataFrame, k: int) -> DataFrame:
    """t with r{k+1}, the rank of depth 2^(k+1), from r{k}."""
    spark = t.sparkSession
    order = Window.partitionBy(*_KEY, "seg").orderBy("idx")
    t = materialise(spark, t.withColumn("nxt", F.coalesce(F.lead(f"r{k}", 1 << k).over(order), F.lit(-1))), f"suffixes-{k}")
    pairs = t.groupBy(F.col(f"r{k}").alias("r"), F.col("nxt").alias("n")).agg(F.count("*").alias("c"))
    lower = F.coalesce(F.sum("c").over(Window.partitionBy("r").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = pairs.select("r", "n", (F.col("r") + lower).alias(f"r{k + 1}"))
    return t.join(ranks, (t[f"r{k}"] == ranks["r"]) & (t["nxt"] == ranks["n"])).drop("r", "n", "nxt")


def suffix_ranks(docs: DataFrame, depth: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positions of repeated lines with the ranks r0, r1, ... of depths 1, 2, 4, ... up to depth."""
    spark = docs.sparkSession
    lines = materialise(spark, line_sequence(docs, id_col, text_col), "lines")
    t = lines.join(line_ranks(lines), ["h1", "h2"]).drop("h1", "h2")
    t = t.repartition(*_KEY).dropDuplicates([*_KEY, "idx"])  # rows that repeat id and text
    t = t.withColumn("seg", F.col("idx") - F.row_number().over(Window.partitionBy(*_KEY).orderBy("idx")))
    for k in range(depth.bit_length() - 1):
        t = deepen(t, k)
    return t


def _windows(min_words: int) -> Column:
    """Sizes n of the windows at a position: at least min_words words, and fewer without the first or the last line."""
    sums = F.aggregate("fw", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return F.filter(
        F.transform(F.slice(sums, 2, min_words), lambda s, i: F.when((s >= min_words) & ((s - F.element_at("fw", i + 1) < min_words) | (s - F.element_at("fw", 1) < min_words)), i + 1)),
        lambda n: n.isNotNull(),
    )


def repeated_runs(docs: DataFrame, min_words: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_d, _h, first_pos, last_pos, n_lines of each maximal run of lines of which an earlier copy exists."""
    spark = docs.sparkSession
    t = suffix_ranks(docs, min_words, id_col, text_col)
    levels = min_words.bit_length()
    frame = Window.partitionBy(*_KEY, "seg").orderBy("idx").rowsBetween(0, min_words - 1)
    t = t.select(*_KEY, "idx", F.collect_list("words").over(frame).alias("fw"), F.collect_list("pos").over(frame).alias("fp"), *[F.collect_list(f"r{k}").over(frame).alias(f"a{k}") for k in range(levels)])
    t = t.withColumn("n", F.explode(_windows(min_words)))
    ra, rb = F.lit(None).cast("long"), F.lit(None).cast("long")
    for k in reversed(range(levels)):
        here = (F.col("n") >= 1 << k) & (F.col("n") < 2 << k)
        ra = F.when(here, F.element_at(f"a{k}", 1)).otherwise(ra)
        rb = F.when(here, F.element_at(f"a{k}", F.col("n") - (1 << k) + 1)).otherwise(rb)
    w = t.select(*_KEY, "idx", "n", ra.alias("ra"), rb.alias("rb"), F.slice("fp", F.lit(1), F.col("n")).alias("fp"))
    w = materialise(spark, w, "line-windows")
    first = w.groupBy("n", "ra", "rb").agg(F.min(F.struct(*_KEY, "idx")).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    later = w.join(first, ["n", "ra", "rb"]).filter(F.struct(*_KEY, "idx") > F.col("first"))
    gone = later.select(*_KEY, "idx", F.posexplode("fp").alias("j", "pos")).select(*_KEY, (F.col("idx") + F.col("j")).alias("idx"), "pos").distinct()
    run = F.col("idx") - F.row_number().over(Window.partitionBy(*_KEY).orderBy("idx"))
    return gone.withColumn("run", run).groupBy(*_KEY, "run").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").cast("int").alias("n_lines")).drop("run")


def clean(docs: DataFrame, min_words: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with later copies of repeated runs deleted from the text, and with lines_deleted and all_deleted.

    all_deleted marks a document that had a line and has none left.
    """
    spark = docs.sparkSession
    runs = materialise(spark, repeated_runs(docs, min_words, id_col, text_col), "line-runs")
    runs = runs.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("first_pos", "last_pos"))).alias("_runs"), F.sum("n_lines").cast("int").alias("_gone"))
    runs = runs.select(F.col("_d").alias("_rd"), F.col("_h").alias("_rh"), "_runs", "_gone")
    rows = _keyed(docs, id_col, text_col)
    out = rows.join(runs, rows["_d"].eqNullSafe(runs["_rd"]) & (rows["_h"] == runs["_rh"]), "left")
    lines = F.split("_text", "\n", -1)
    begins = F.concat(F.array(F.lit(0)), F.transform("_runs", lambda r: r["last_pos"] + 1))
    ends = F.concat(F.transform("_runs", lambda r: r["first_pos"]), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(lines, a + 1, b - a)))
    out = out.withColumn("_text", F.when(F.col("_runs").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n")))
    plain = [F.col("_text").alias(c) if c.lower() == text_col.lower() else F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("lines_deleted", "all_deleted")]
    gone = F.coalesce("_gone", F.lit(0))
    return out.select(*plain, gone.alias("lines_deleted"), ((gone > 0) & ~F.col("_text").rlike(SIGN)).alias("all_deleted"))
