"""Token counts through a digest cache.

Content and tokenizer-version digests key a stored table of counts. A batch is digested in the JVM, the
distinct digests that the cache lacks are encoded once each, appended, and the counts joined back.

Counting works on pieces of text between spaces. That is exact for a vocabulary none of whose pieces holds
the white-space mark after another character (checked when a model is loaded): no merge can then reach over
the start of a run of spaces. Other vocabularies, and texts that hold the mark itself, are encoded whole.

Defined results: null text counts as empty and has no tokens; repeated rows and ids each get a row; an empty
table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import filesystem

MARK = "▁"
#: Entries that a worker remembers, and the longest piece of text among them.
REMEMBERED, LONGEST = 300_000, 64
_LOADED: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """Counts tokens of whole texts as the sentencepiece library encodes them."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        whole = self.model.encode
        self.separable = (
            not any(MARK in p.lstrip(MARK) or " " in p for p in map(self.model.id_to_piece, range(self.model.get_piece_size())))
            and self.model.piece_to_id(MARK) != self.model.unk_id()
            and whole("a  b c ") == whole("a") + whole(" b") + whole("c") + [self.model.piece_to_id(MARK)]
        )
        self.counts: dict[str, int] = {}

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.separable or MARK in text:
            return len(self.model.encode(text, num_threads=1))
        parts, total = text.split(" "), 0
        if "" in parts:
            runs = re.findall(r" *[^ ]+| +$", " " + text)
            if runs[-1] == " ":  # one space at the end is a mark of its own
                runs.pop()
                total = 1
            parts = [x[1:] for x in runs]
        get = self.counts.get
        found = list(map(get, parts))
        if None not in found:
            return total + sum(found)
        missing = list({p for p, n in zip(parts, found, strict=True) if n is None})
        new = dict(zip(missing, map(len, self.model.encode(missing, num_threads=1)), strict=True))
        total += sum(new[p] if n is None else n for p, n in zip(parts, found, strict=True))
        if len(self.counts) > REMEMBERED:
            self.counts.clear()
        self.counts.update((p, n) for p, n in new.items() if len(p) <= LONGEST)
        return total


def counter(model_path: str) -> PieceCounter:
    if model_path not in _LOADED:
        _LOADED[model_path] = PieceCounter(model_path)
    return _LOADED[model_path]


def tokenizer_digest(model_path: str) -> str:
    """Of the vocabulary file's bytes: another version of the file never meets old counts."""
    with open(model_path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def count_tokens(docs: DataFrame, model_path: str, cache_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for each row; the cache at cache_path gains what it lacked."""
    spark = docs.sparkSession
    version = tokenizer_digest(model_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("content"), F.sha2(text, 256).alias("digest"))
    known = read_cache(spark, cache_path).filter(F.col("tokenizer") == version).select("digest", "n_tokens")
    missing = keyed.select("digest", "content").dropDuplicates(["digest"]).join(known, "digest", "left_anti")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(model_path).count
        for b in batches:
            yield pd.DataFrame({"tokenizer": version, "digest": b["digest"], "n_tokens": [count(t) for t in b["content"]]})

    missing.mapInPandas(encode, "tokenizer string, digest string, n_tokens long").write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = keyed.select("id", F.octet_length("content").cast("long").alias("n_bytes"), "digest")
    return rows.join(counts, "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an absent cache is an empty one."""
    schema = "tokenizer string, digest string, n_tokens long"
    fs, make = filesystem(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(make(path)) else spark.createDataFrame([], schema)
