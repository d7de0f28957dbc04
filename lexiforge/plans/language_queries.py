"""Queries of the language, summary and lexicon operators over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.operators import language as lg
from lexiforge.operators import summary as su
from lexiforge.operators.staging import staged
from lexiforge.plans import tables


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, lang; the column lang makes the reference tables."""
    return tables.documents(spark, sf_dir, "doc_id", "text", "lang")


def tier_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = known(spark, sf_dir)
    freq = staged(lg.frequencies(d))
    return lg.detect(d.select("doc_id", "text"), staged(lg.frequency_model(freq)), freq)


def reference_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.lexicon(lg.frequencies(known(spark, sf_dir))).withColumn("zipf", F.round("zipf", 4))


def _with_frequencies(f):
    return lambda spark, sf_dir: f(known(spark, sf_dir), lg.frequencies(known(spark, sf_dir)))


QUERIES = {
    "script_shares": lambda s, d: lg.script_shares(known(s, d)),
    "script_profile": lambda s, d: lg.script_profile(known(s, d)),
    "reference_lexicon": reference_lexicon,
    "vocab_coverage": _with_frequencies(lg.vocab_coverage),
    "lexicon_rate": _with_frequencies(lambda d, freq: lg.lexicon_rate(d, lg.lexicon(freq))),
    "language_candidates": lambda s, d: lg.language_candidates(known(s, d).select("doc_id", "text"), lg.trigram_model(known(s, d))),
    "tier_routing": tier_routing,
    "keywords": _with_frequencies(su.keywords),
    "extractive_summary": _with_frequencies(su.extractive_summary),
}
