"""Structural findings over tokens: affixes (M1-M7), dispersion, positions, numerals, names (M12-M19), keyed by doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiforge.operators.statistics import rounded, signs_tallied

def _by_doc():
    return Window.partitionBy("doc_id")


def word_types(t: DataFrame, reverse: bool = False) -> DataFrame:
    """doc_id, w: each document's word types, dealt by document. All of M1-M6 keeps this partitioning, so it is the family's one exchange."""
    word = F.reverse("token") if reverse else F.col("token")
    return t.groupBy("doc_id", word.alias("w")).agg(F.lit(1).alias("one")).select("doc_id", "w").repartition("doc_id")


def splits(t: DataFrame, reverse: bool = False) -> DataFrame:
    """M1: doc_id, w, k, stem, suf of every word type with endings of one to three signs and stems of two at least."""
    return _splits(word_types(t, reverse))


def _splits(types: DataFrame, whole: bool = False) -> DataFrame:
    """Splits; with ``whole`` also each word as a stem of its own, where k is 0 and suf empty."""
    ends = types.select("doc_id", "w", F.explode(F.expr(f"filter(sequence({0 if whole else 1}, 3), k -> k = 0 OR char_length(w) - k >= 2)")).alias("k"))
    return ends.select("doc_id", "w", "k", F.expr("substring(w, 1, char_length(w) - k)").alias("stem"), F.expr("right(w, k)").alias("suf"))


def _productive(types: DataFrame) -> DataFrame:
    """M2: the splits whose stem has two endings at least, the bare stem (of three signs) counting as one; and the words themselves, with k 0."""
    s = _splits(types, whole=True)
    stem = Window.partitionBy("doc_id", "stem")
    n = F.count_if(F.col("k") > 0).over(stem)
    bare = F.max(F.when((F.col("k") == 0) & (F.char_length("w") >= 3), 1).otherwise(0)).over(stem)
    s = s.withColumn("open", (F.col("k") > 0) & (n + bare >= 2)).withColumn("is_word", F.max((F.col("k") == 0).cast("int")).over(stem))
    s = s.filter("open")
    return s.withColumn("score", F.count("*").over(Window.partitionBy("doc_id", "suf")))


def productive(t: DataFrame, reverse: bool = False) -> DataFrame:
    """M2: doc_id, w, k, stem, suf, score (stems of the ending) of the splits that count."""
    return _productive(word_types(t, reverse)).select("doc_id", "w", "k", "stem", "suf", "score")


def affix_scores(t: DataFrame, reverse: bool = False, k: int = 12) -> DataFrame:
    """M2, M6: the k best endings (beginnings if reverse) by number of stems; of equal scores in the order of their signs."""
    p = productive(t, reverse).groupBy("doc_id", "suf").agg(F.max("score").alias("score"))
    affix = F.reverse("suf") if reverse else F.col("suf")
    p = p.withColumn("affix", affix).withColumn("rk", F.row_number().over(_by_doc().orderBy(F.desc("score"), "affix")))
    return p.filter(F.col("rk") <= k).select("doc_id", "rk", "affix", "score")


def _best(t: DataFrame, reverse: bool) -> DataFrame:
    p = _productive(word_types(t, reverse)).withColumn("v", F.struct((F.col("score") * (100 + 15 * F.col("k"))).alias("x"), "stem", "suf", "is_word"))
    return p.groupBy("doc_id", "w").agg(F.max("v").alias("v")).select("doc_id", "w", "v.stem", "v.suf", "v.is_word")


def best_splits(t: DataFrame, reverse: bool = False) -> DataFrame:
    """M3: for each word type the split of greatest (score (1 + 0.15 k), stem, ending)."""
    return _best(t, reverse).select("doc_id", "w", "stem", "suf")


def paradigms(t: DataFrame, reverse: bool = False) -> DataFrame:
    """M4: doc_id, stem, e: the sorted endings of stems with two or more; a bare stem that is a word adds the empty ending."""
    e = _best(t, reverse).groupBy("doc_id", "stem").agg(F.collect_set("suf").alias("e"), F.max("is_word").alias("is_word"))
    e = e.select("doc_id", "stem", F.array_sort(F.when(F.col("is_word") > 0, F.array_append("e", F.lit(""))).otherwise(F.col("e"))).alias("e"))
    return e.filter("size(e) >= 2")


def signatures(t: DataFrame, reverse: bool = False, k: int | None = 8) -> DataFrame:
    """M5: sets of endings that three or more stems share; the k first by stems times endings (all for None), with the first stems as examples."""
    sigs = paradigms(t, reverse).groupBy("doc_id", "e").agg(F.count("*").alias("stems"), F.slice(F.array_sort(F.collect_list("stem")), 1, 4).alias("examples"))
    sigs = sigs.filter("stems >= 3").withColumn("endings", F.array_join("e", "|"))
    order = _by_doc().orderBy((-F.col("stems") * F.size("e")), "endings")
    sigs = sigs.withColumn("rk", F.row_number().over(order))
    return (sigs if k is None else sigs.filter(F.col("rk") <= k)).select("doc_id", "rk", "endings", "stems", "examples")


def paradigm_words(t: DataFrame, reverse: bool = False) -> DataFrame:
    """M6: doc_id, token: the words of all paradigms."""
    w = paradigms(t, reverse).select("doc_id", "stem", F.explode("e").alias("suf")).select("doc_id", F.concat("stem", "suf").alias("w"))
    return w.select("doc_id", (F.reverse("w") if reverse else F.col("w")).alias("token")).distinct()


def dispersion(t: DataFrame) -> DataFrame:
    """The share of ten chunks of a document that have the word; the rest after the tenth is left out."""
    t = t.withColumn("n", F.count("*").over(_by_doc())).withColumn("size", F.expr("greatest(1, n div 10)"))
    t = t.withColumn("chunk", F.expr("tok_idx div size"))
    chunks = F.expr("least(10, ceil(n / size))")
    return t.withColumn("chunks", chunks).groupBy("doc_id", "token").agg(F.round(F.count_distinct(F.when(F.col("chunk") < 10, F.col("chunk"))) / F.max("chunks"), 4).alias("dispersion"))


def positional(t: DataFrame) -> DataFrame:
    """Words tied to the first or last place of units of three tokens: 2.5 times chance, five uses; the first 8 of each side."""
    u = t.filter("unit_len >= 3")
    at = [F.sum((F.col("pos") == p).cast("long")).alias(a) for p, a in ((F.lit(0), "first"), (F.col("unit_len") - 1, "last"))]
    w = u.groupBy("doc_id", "token").agg(F.count("*").alias("c"), *at, F.min("tok_idx").alias("seen"))
    w = w.withColumn("base", F.sum("first").over(_by_doc()) / F.sum("c").over(_by_doc())).filter("c >= 5")
    sides = w.select("doc_id", "token", "c", "base", "seen", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("h")) for s in ("first", "last")])).alias("x"))
    sides = sides.withColumn("ratio", F.col("x.h") / F.col("c") / F.col("base")).filter("ratio >= 2.5").withColumn("r", rounded(F.col("ratio"), 1))
    order = Window.partitionBy("doc_id", "x.side").orderBy(-rounded(F.col("r") * F.log1p("c"), 9), "seen")
    return sides.withColumn("rk", F.row_number().over(order)).filter("rk <= 8").select("doc_id", "x.side", "rk", "token", "c", rounded(F.col("x.h") / F.col("c"), 2).alias("share"), F.col("r").alias("ratio"))


def numeral_signs(t: DataFrame) -> DataFrame:
    """Digits, and signs that stand next to themselves far more often than by chance, like tally strokes."""
    pairs = F.transform(F.sequence(F.lit(1), F.char_length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))
    twice = t.filter("char_length(token) >= 2").select("doc_id", F.explode(pairs).alias("p")).filter("substring(p, 1, 1) = substring(p, 2, 1)")
    twice = twice.groupBy("doc_id", F.substring("p", 1, 1).alias("sign")).agg(F.count("*").alias("doubled"))
    s = signs_tallied(t).join(twice, ["doc_id", "sign"], "left").withColumn("doubled", F.coalesce("doubled", F.lit(0))).withColumn("total", F.sum("c").over(_by_doc()))
    digit = F.col("sign").rlike(r"^\p{Nd}$")
    tally = (F.col("c") >= 5) & (F.col("doubled") / F.col("c") >= 0.25) & (F.col("doubled") / F.col("c") > 5 * F.col("c") / F.col("total"))
    return s.filter(digit | tally).select("doc_id", "sign", "c", F.when(digit, "digit").otherwise("tally").alias("kind"))


def with_numbers(t: DataFrame, signs: DataFrame | None = None) -> DataFrame:
    """Tokens with is_num: made of numeral signs alone, those of t or those given (doc_id, sign)."""
    nums = (numeral_signs(t) if signs is None else signs).groupBy("doc_id").agg(F.collect_set("sign").alias("nums"))
    t = t.join(nums, "doc_id", "left")
    all_num = F.forall(F.filter(F.split("token", ""), lambda c: c != ""), lambda c: F.array_contains("nums", c))
    return t.withColumn("is_num", F.coalesce(all_num, F.lit(False))).drop("nums")


def number_context(t: DataFrame) -> DataFrame:
    """Words next to numbers three times and three times more often than by chance; the first 8 by count times lift."""
    t = with_numbers(t)
    order = Window.partitionBy("doc_id", "unit_idx").orderBy("pos")
    t = t.withColumn("next_num", F.lead("is_num").over(order)).withColumn("last_num", F.lag("is_num").over(order))
    totals = t.groupBy("doc_id").agg(F.sum(F.col("is_num").cast("long")).alias("n_num"), F.count("*").alias("n"))
    words = t.filter("NOT is_num").groupBy("doc_id", "token").agg(F.count("*").alias("f"), F.sum(F.col("next_num").cast("long")).alias("before"), F.sum(F.col("last_num").cast("long")).alias("after"), F.min("tok_idx").alias("seen"))
    sides = words.join(totals, "doc_id").select("doc_id", "token", "f", "n_num", "n", "seen", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("c")) for s in ("before", "after")])).alias("x"))
    sides = sides.withColumn("lift", F.col("x.c") / (F.col("n_num") * F.col("f") / F.col("n"))).filter("x.c >= 3 AND lift >= 3")
    order = _by_doc().orderBy(-F.col("x.c") * F.round("lift", 1), F.desc("x.side"), "seen")
    return sides.withColumn("rk", F.row_number().over(order)).filter("rk <= 8").select("doc_id", "rk", "token", "x.side", "x.c", F.round("lift", 1).alias("lift"))


def caseless_names(t: DataFrame, inflected: DataFrame | None = None) -> DataFrame:
    """Words of two to eight uses, not short, within a fifth of the text and none of inflected (doc_id, token); the first 12."""
    w = t.groupBy("doc_id", "token").agg(F.count("*").alias("c"), F.min("tok_idx").alias("a"), F.max("tok_idx").alias("b"))
    w = w.withColumn("n", F.sum("c").over(_by_doc()))
    med = w.groupBy("doc_id").agg(F.percentile(F.char_length("token"), F.lit(0.5)).alias("med"))
    w = w.join(med, "doc_id").filter("c BETWEEN 2 AND 8 AND char_length(token) >= med AND (b - a) / n <= 0.2")
    if inflected is not None:
        w = w.join(inflected, ["doc_id", "token"], "left_anti")
    return w.withColumn("rk", F.row_number().over(_by_doc().orderBy(F.desc("c"), "a"))).filter("rk <= 12").select("doc_id", "rk", "token", "c")
