"""Queries of the structural findings over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.operators import corpus as oc
from lexiforge.operators import findings as fi
from lexiforge.operators.staging import staged
from lexiforge.operators.wordforms import found
from lexiforge.plans import tables


def analysed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The corpus of the documents and its tokens, these written once."""
    c = oc.corpus(tables.documents(spark, sf_dir))
    return c, staged(oc.tokens(c))


def forms(spark: SparkSession, sf_dir: str, rest: bool = True) -> DataFrame:
    return found(oc.corpus(tables.documents(spark, sf_dir)), rest, sets=False)


def affix_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.affix_control(forms(spark, sf_dir, rest=False))


def function_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.function_words(forms(spark, sf_dir))


def word_order_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.word_order(forms(spark, sf_dir))


def name_candidates_cased(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = analysed(spark, sf_dir)
    return fi.cased_names(c, t)


def name_candidates_uninflected(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = oc.corpus(tables.documents(spark, sf_dir))
    return fi.uninflected_names(c, c)


def affix_signatures_controlled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = oc.corpus(tables.documents(spark, sf_dir))
    return fi.controlled_signatures(c, c).drop("examples")


def sign_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigrams of signs inside words, with two boundaries before and one after."""
    padded = F.concat(F.lit("##"), "token", F.lit("#"))
    grams = F.transform(F.sequence(F.lit(1), F.char_length("token") + 1), lambda i: F.substring(padded, i, F.lit(3)))
    return analysed(spark, sf_dir)[1].select("doc_id", F.explode(grams).alias("gram")).groupBy("doc_id", "gram").agg(F.count("*").alias("c"))


QUERIES = {f.__name__: f for f in (affix_control, function_words, word_order_hint, name_candidates_cased, name_candidates_uninflected, affix_signatures_controlled, sign_trigrams)}
