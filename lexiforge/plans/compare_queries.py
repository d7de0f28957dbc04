"""Queries of the comparison with reference languages over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import text as ft
from lexiforge.operators import compare as co
from lexiforge.operators import corpus as oc
from lexiforge.operators import findings as fi
from lexiforge.operators import language as lg
from lexiforge.operators.staging import staged
from lexiforge.operators.wordforms import found
from lexiforge.plans.language_queries import known
from lexiforge.plans import tables


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(lg.lexicon(lg.frequencies(known(spark, sf_dir))))


def corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(oc.corpus(tables.documents(spark, sf_dir)).drop("raw"))


def profiles(c: DataFrame) -> DataFrame:
    t = oc.tokens(c)
    return co.doc_profile(t, fi.affix_control(found(c, rest=False, sets=False)))


def available_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11, F23."""
    return lexicon(spark, sf_dir).select("lang").distinct().select("lang", ft.language_name(F.col("lang")).alias("name"))


def reference_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.reference_profiles(lexicon(spark, sf_dir))


def doc_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(corpora(spark, sf_dir))


def profile_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.closest(doc_profiles(spark, sf_dir), reference_profiles(spark, sf_dir))


def deletion_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.deletion_index(lexicon(spark, sf_dir))


def _matched(spark: SparkSession, sf_dir: str, lex: DataFrame, n: int | None) -> DataFrame:
    c, langs = oc.corpus(tables.documents(spark, sf_dir)), lex.select("lang").distinct()
    few = [r["lang"] for r in langs.orderBy("lang").limit(co.MOST_LANGUAGES + 1).collect()]
    languages = few if len(few) <= co.MOST_LANGUAGES else c.select("doc_id").crossJoin(langs)
    return co.lexical_matching(c, languages, staged(co.deletion_index(lex, n)))


def lexical_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, lexicon(spark, sf_dir), co.INDEX_WORDS).withColumn("examples", F.array_join("examples", " "))


def look_alikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8 without a cut: all languages that pass, against all words of each."""
    whole = staged(lg.lexicon(lg.frequencies(known(spark, sf_dir)), None))
    return co.look_alikes(_matched(spark, sf_dir, whole, None), None).drop("examples")


def letter_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.letter_model(staged(co.letter_counts(lexicon(spark, sf_dir))))


def deciphered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12-J16 of the documents that no language is found for, against English and German."""
    d = known(spark, sf_dir)
    freq = staged(lg.frequencies(d))
    lex = staged(lg.lexicon(freq))
    unknown = lg.detect(d.select("doc_id", "text"), staged(lg.frequency_model(freq)), freq).filter("tier = 2").select("doc_id")
    c = staged(oc.corpus(d.join(unknown, "doc_id", "left_semi").select("doc_id", "text")))
    languages = ["de", "en"]
    out = co.decipher(c, languages, staged(co.letter_counts(lex.filter(F.col("lang").isin(languages)))), lex)
    return out.withColumn("mapping", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("mapping"))))).withColumn("top_hits", F.array_join("top_hits", " "))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiforge.operators import structure as ms

    c = corpora(spark, sf_dir)
    t = oc.tokens(c)
    return co.anchors(lg.script_shares(known(spark, sf_dir)), ms.numeral_signs(t), ms.caseless_names(t))


def labels_and_transliteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3-F5, F17, F18 on the lexicon's words written in private-use signs and back."""
    w = lexicon(spark, sf_dir).filter(F.col("word").rlike("^[a-z]+$")).select("lang", "word")
    hidden = F.array_join(F.transform(F.split("word", ""), lambda c: F.decode(F.unhex(F.lpad(F.hex((F.ascii(c) + 0xE000 - 97).cast("long")), 8, "0")), "UTF-32")), "")
    w = w.withColumn("shown", ft.show(hidden))
    back = ft.parse_label(F.col("shown"), F.lit(False)) == hidden
    return w.select("lang", "word", "shown", back.alias("parsed_back"), F.array_join(F.array_sort(ft.deletions(F.col("word"))), " ").alias("variants"))


QUERIES = {f.__name__: f for f in (available_languages, reference_profiles, doc_profiles, profile_distance, deletion_index, lexical_matching, look_alikes, letter_model, deciphered, anchors, labels_and_transliteration)}
