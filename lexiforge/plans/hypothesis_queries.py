"""Tests of a fixed list of hypotheses on every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.operators import corpus as oc
from lexiforge.operators import hypotheses as hy
from lexiforge.operators.staging import staged
from lexiforge.plans.compare_queries import lexicon
from lexiforge.plans import tables

LINES = [
    "gloss the = ARTICLE near line_start", "gloss und = AND near der", "gloss de = OF near line_end", "gloss et = AND near numbers", "gloss the = ARTICLE",
    "role the function_word", "role und unit_start", "role de unit_end", "role et name", "role the number", "role the verb",
    "affix -ing = GERUND", "affix be- = PREFIX", "affix -en = PLURAL", "values G001=a G002=b in de", "guess what",
]


def parse_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame(list(enumerate(LINES)), "hyp int, line string")
    return hy.parse(lines).withColumn("pairs", F.array_join(F.transform("pairs", lambda p: F.concat(p["sign"], F.lit(":"), p["value"])), ","))


def gloss_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = oc.corpus(tables.documents(spark, sf_dir))
    return hy.gloss_test(c, c, LINES)


def role_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = oc.corpus(tables.documents(spark, sf_dir))
    return hy.role_test(c, c, LINES)


def affix_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = oc.corpus(tables.documents(spark, sf_dir))
    return hy.affix_test(c, c, LINES)


VALUES = ["values e=e t=t a=a o=o n=n i=i s=s r=r l=l u=u in en"]


def counterexamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = staged(oc.corpus(tables.documents(spark, sf_dir)).drop("raw"))
    return hy.counterexamples(c, c, oc.tokens(c), LINES)


def values_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = oc.corpus(tables.documents(spark, sf_dir))
    return hy.values_test(c, c, VALUES, lexicon(spark, sf_dir))


def hypothesis_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = oc.corpus(tables.documents(spark, sf_dir))
    return hy.verdicts(c, c, c, LINES, lexicon(spark, sf_dir)).drop("evidence")


QUERIES = {f.__name__: f for f in (parse_hypotheses, gloss_test, role_test, affix_test, counterexamples, values_test, hypothesis_verdicts)}
