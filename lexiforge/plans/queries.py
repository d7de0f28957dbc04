"""A query for each operator over the documents table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import text as ft
from lexiforge.operators import corpus as oc
from lexiforge.operators import statistics as st
from lexiforge.operators import structure as ms
from lexiforge.plans import tables


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oc.tokens(oc.corpus(documents(spark, sf_dir)))


def _of(f: Callable[..., DataFrame], *args, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(tokens(spark, sf_dir), *args, **options)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = oc.corpus(documents(spark, sf_dir)).select("doc_id", "unit_kind", F.posexplode("units").alias("unit_idx", "u"))
    return c.select("doc_id", "unit_kind", "unit_idx", F.array_join("u", " ").alias("unit"))


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.redact(documents(spark, sf_dir))


def condition_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", *ft.condition(F.col("text")))


def doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", ft.document_type(F.col("text")).alias("doc_type"))


def corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oc.corpus(documents(spark, sf_dir))


def structure_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.structure(corpora(spark, sf_dir))


def divider_like_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpora(spark, sf_dir)
    return st.divider_like_signs(oc.tokens(c), c)


def unspaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without white space: every other one with a private-use sign in its place, the rest with none."""
    even = F.pmod(F.col("doc_id"), F.lit(2)) == 0
    return documents(spark, sf_dir).withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", F.when(even, F.lit("\ue020")).otherwise(F.lit(""))))


def unspaced_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3, T4, T10 on texts without white space; and F3, F4 on the divider."""
    c = oc.corpus(unspaced(spark, sf_dir))
    return c.select("doc_id", F.regexp_replace("separator", "\ue020", ft.show(F.lit("\ue020"))).alias("separator"), F.size(F.flatten("units")).cast("long").alias("tokens"))


def unspaced_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oc.notes(oc.corpus(unspaced(spark, sf_dir))).select("doc_id", "seq", F.replace("note", F.lit("\ue020"), ft.show(F.lit("\ue020"))).alias("note"))


QUERIES = {
    "units": units,
    "tokens": lambda s, d: tokens(s, d).select("doc_id", "unit_idx", "pos", "unit_len", "tok_idx", "token"),
    "sign_frequency": _of(st.sign_frequency),
    "sign_inventory": _of(st.sign_inventory),
    "divider_like_signs": divider_like_signs,
    "signs_per_word": lambda s, d: st.signs_per_word(corpora(s, d)),
    "sample_units": lambda s, d: oc.sample(corpora(s, d)),
    "unspaced_separators": unspaced_separators,
    "unspaced_notes": unspaced_notes,
    "zipf_curve": lambda s, d: st.zipf_curve(corpora(s, d)),
    "conditional_entropy": lambda s, d: st.conditional_entropy(tokens(s, d)).withColumn("h_cond", F.round("h_cond", 4)),
    "word_statistics": _of(st.word_statistics),
    "zipf_fit": _of(st.zipf_fit),
    "top_words": lambda s, d: st.top(tokens(s, d), "token", "tok_idx", 25),
    "top_bigrams": lambda s, d: st.top(st.ngrams(tokens(s, d), 2), "gram", "at", 15),
    "top_trigrams": lambda s, d: st.top(st.ngrams(tokens(s, d), 3), "gram", "at", 15),
    "structure_verdict": structure_verdict,
    "redact_documents": redact_documents,
    "condition_notes": condition_notes,
    "doc_type": doc_type,
    "affix_scores": _of(ms.affix_scores),
    "prefix_scores": _of(ms.affix_scores, reverse=True),
    "affix_best_split": _of(ms.best_splits),
    "affix_signatures": lambda s, d: ms.signatures(tokens(s, d)).drop("examples"),
    "dispersion": _of(ms.dispersion),
    "positional_words": _of(ms.positional),
    "numeral_signs": _of(ms.numeral_signs),
    "number_context": _of(ms.number_context),
    "name_candidates_caseless": _of(ms.caseless_names),
}
