"""Statistical profile of tokens and signs (A1-A19, F20) and its shuffled control, keyed by doc_id."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiforge.operators.batches import mapped
from lexiforge.operators.corpus import signs
from lexiforge.operators.shuffle import codes, shuffled_texts

#: The shuffles whose averages are the control.
SEEDS = [0, 1, 2, 3, 4]


def _by_doc():
    return Window.partitionBy("doc_id")


def tallied(rows: DataFrame, column: str, at: str) -> DataFrame:
    """doc_id, column, c, first (its first place); one exchange after counting inside each task."""
    return rows.groupBy("doc_id", column).agg(F.count("*").alias("c"), F.min(at).alias("first"))


def signs_tallied(t: DataFrame) -> DataFrame:
    return tallied(signs(t).withColumn("at", F.struct("tok_idx", "sign_in_tok")), "sign", "at")


def bits(c: Column, digits: int = 12) -> Column:
    """the entropy of a group's counts, log2 n - sum(c log2 c) / n."""
    n = F.sum(c)
    return F.round(F.log2(n) - F.sum(c * F.log2(c)) / n, digits) + 0.0


def rounded(x: Column, digits: int) -> Column:
    """x to some digits as SQL on doubles has it: x 10^digits, rounded half away from zero, over 10^digits. F.round goes by the decimal form of x, and so differs next to halves."""
    return F.round(x * 10.0**digits) / 10.0**digits


def sign_frequency(t: DataFrame) -> DataFrame:
    """A1, A7."""
    return signs_tallied(t).select("doc_id", "sign", "c")


def sign_inventory(t: DataFrame) -> DataFrame:
    """Inventory, Chao1 estimate, unseen mass, entropy and kind of writing system."""
    one, two = F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))
    return inventory(signs_tallied(t).groupBy("doc_id").agg(F.sum("c").alias("total_signs"), F.count("*").alias("distinct_signs"), one.alias("hapax_signs"), two.alias("twice"), bits(F.col("c")).alias("h1")))


def inventory(counted: DataFrame) -> DataFrame:
    """A2-A4, F13, F20 of doc_id, total_signs, distinct_signs, hapax_signs, twice, h1."""
    out = counted.select("doc_id", "total_signs", "distinct_signs", F.col("hapax_signs").alias("f1"), F.col("twice").alias("f2"), (F.round("h1", 12) + 0.0).alias("h1"))
    chao = F.col("distinct_signs") + F.when(F.col("f2") > 0, F.col("f1") * F.col("f1") / (2.0 * F.col("f2"))).otherwise(F.col("f1") * (F.col("f1") - 1) / 2.0)
    out = out.withColumn("chao1", chao)
    n = F.round("chao1")
    kind = F.when(n <= 40, "alphabet or abjad").when(n <= 100, "syllabary (possibly with some logograms)").when(n <= 1000, "logo-syllabic system").otherwise("logographic system")
    return out.select("doc_id", "total_signs", "distinct_signs", F.col("f1").alias("hapax_signs"), F.round("chao1", 1).alias("chao1_inventory"), F.round(F.col("f1") / F.col("total_signs"), 4).alias("unseen_mass"), F.round("h1", 4).alias("h1"), kind.alias("system_type"))


def signs_per_word(c: DataFrame) -> DataFrame:
    """A5: doc_id, separator, signs_per_word of a corpus; null without words or word boundaries."""
    words = F.flatten("units")
    mean = F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.char_length(w)) / F.size(words)
    return c.select("doc_id", "separator", F.round(F.when((F.col("separator") != "none") & (F.size(words) > 0), mean), 4).alias("signs_per_word"))


def divider_like_signs(t: DataFrame, separators: DataFrame) -> DataFrame:
    """One-sign tokens that make up at least 80 % of their sign's uses, in documents (doc_id, separator) with word boundaries."""
    t = t.join(separators.filter("separator != 'none'").select("doc_id"), "doc_id", "left_semi")
    single = t.filter(F.char_length("token") == 1).groupBy("doc_id", F.col("token").alias("sign")).agg(F.count("*").alias("alone"))
    return single.join(signs_tallied(t), ["doc_id", "sign"]).filter("alone >= 5 AND alone / c >= 0.8").select("doc_id", "sign", "alone")


def conditional_entropy(t: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A9 over padded bigrams (F15), for each value of the keys."""
    keys = keys or ["doc_id"]
    padded = F.concat(F.lit("^"), "token", F.lit("$"))
    pairs = t.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.char_length("token") + 1), lambda i: F.substring(padded, i, F.lit(2)))).alias("ab"))
    pairs = pairs.groupBy(*keys, "ab").agg(F.count("*").alias("c"))
    # H(b | a) = (sum of n_a log2 n_a - sum of n_ab log2 n_ab) / n, each sum taken by partial aggregates
    first = pairs.groupBy(*keys, F.substring("ab", 1, 1).alias("a")).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return first.groupBy(*keys).agg((F.round((F.sum(F.col("n") * F.log2("n")) - F.sum("s")) / F.sum("n"), 12) + 0.0).alias("h_cond"))


def word_statistics(t: DataFrame) -> DataFrame:
    """Tokens, types, type/token ratio, mean length, word entropy."""
    w = tallied(t, "token", "tok_idx")
    return w.groupBy("doc_id").agg(
        F.sum("c").alias("tokens"), F.count("*").alias("types"), F.round(F.count("*") / F.sum("c"), 4).alias("ttr"),
        F.round(F.sum(F.col("c") * F.char_length("token")) / F.sum("c"), 4).alias("mean_length"), F.round(bits(F.col("c")), 4).alias("h_word"),
    )


def zipf_fit(t: DataFrame) -> DataFrame:
    """Least squares of log10 frequency on log10 rank over words seen twice; needs five."""
    w = tallied(t, "token", "tok_idx").withColumn("rk", F.row_number().over(_by_doc().orderBy(F.desc("c"), "first"))).filter("c >= 2")
    w = w.select("doc_id", F.log10(F.col("rk").cast("double")).alias("x"), F.log10(F.col("c").cast("double")).alias("y"))
    fit = w.groupBy("doc_id").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.regr_r2("y", "x").alias("r2"), F.stddev_pop("y").alias("sd"), F.count("*").alias("fitted_ranks"))
    return fit.filter("fitted_ranks >= 5").select("doc_id", F.round(0.0 - F.col("b"), 3).alias("slope"), F.round("a", 3).alias("intercept"), F.when(F.col("sd") == 0, 1.0).otherwise(F.round("r2", 3)).alias("r2"), "fitted_ranks")


def top(rows: DataFrame, column: str, at: str, k: int) -> DataFrame:
    """The k most frequent values of each document; of equal counts the first seen."""
    return tallied(rows, column, at).withColumn("rk", F.row_number().over(_by_doc().orderBy(F.desc("c"), "first"))).filter(F.col("rk") <= k).select("doc_id", "rk", column, "c")


def ngrams(t: DataFrame, n: int) -> DataFrame:
    """doc_id, gram, at of the n-grams inside tokens."""
    grams = F.transform(F.sequence(F.lit(1), F.char_length("token") - n + 1), lambda i: F.substring("token", i, F.lit(n)))
    rows = t.filter(F.char_length("token") >= n).select("doc_id", "tok_idx", F.posexplode(grams).alias("i", "gram"))
    return rows.select("doc_id", "gram", F.struct("tok_idx", "i").alias("at"))


def gathered(t: DataFrame) -> DataFrame:
    """doc_id, places, words: each document's tokens in one row, in the order of the text."""
    rows = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("tok_idx", "token"))).alias("x"))
    return rows.select("doc_id", F.col("x.tok_idx").alias("places"), F.col("x.token").alias("words"))


def joined(words: Column) -> Column:
    """Words in one text, a line each: no word holds a line end, and Arrow carries a text faster than an array."""
    return F.array_join(words, "\n")


def shuffled_words(rows: DataFrame, seeds: list[int]) -> DataFrame:
    """Rows (doc_id, words, other columns) once for each seed, with ``words`` shuffled: a document's signs permuted and dealt to the same lengths.

    The permutation sorts signs by md5 of seed, document and place: reproducible on any cluster, and inside one row.
    """
    rows = rows.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    rows = mapped(rows.withColumn("_key", F.concat_ws(":", "seed", "doc_id")).withColumn("words", joined(F.col("words"))), ["_key", "words"], "words string", lambda keys, texts: ((x,) for x in shuffled_texts(list(zip(keys, texts, strict=True)))))
    return rows.withColumn("words", F.filter(F.split("words", "\n"), lambda w: w != ""))


def shuffled(t: DataFrame, seeds: list[int]) -> DataFrame:
    """A14 of tokens: doc_id, seed, tok_idx, token."""
    rows = shuffled_words(gathered(t), seeds)
    pairs = F.explode(F.arrays_zip("places", "words")).alias("x")
    return rows.select("doc_id", "seed", pairs).select("doc_id", "seed", F.col("x.places").alias("tok_idx"), F.col("x.words").alias("token"))


_PROFILE = "h_cond double, types double, h_shuffled double, types_shuffled double, a double, b double, r2 double, fitted_ranks long, freqs array<double>, freqs_shuffled array<double>"


def conditional_bits(d: np.ndarray, k: int, sep: int, hat: int, end: int) -> float:
    """A9 of a text in codes below k, words divided by sep, with marks hat and end around them."""
    left = np.concatenate([[hat], d[:-1]])
    left[left == sep] = hat
    inside, last = d != sep, np.append(d[1:] == sep, True)
    pairs = np.concatenate([left[inside] * k + d[inside], d[last] * k + end])
    if k * k <= 1 << 16:
        c = np.bincount(pairs, minlength=k * k)
        n = c.reshape(k, k).sum(1)
    else:
        at, c = np.unique(pairs, return_counts=True)
        n = np.bincount(at // k, c)
    c, n = c[c > 0].astype(float), n[n > 0].astype(float)
    return round(float(((n * np.log2(n)).sum() - (c * np.log2(c)).sum()) / n.sum()), 12) + 0.0


def fit(freqs: list[int]) -> tuple[float | None, float | None, float | None, int]:
    """Intercept, slope, R2 and number of the ranks seen twice, of frequencies in falling order."""
    y = np.log10(np.array([f for f in freqs if f >= 2], float))
    if len(y) < 5:
        return None, None, None, len(y)
    x = np.log10(np.arange(1, len(y) + 1, dtype=float))
    dx, dy = x - x.mean(), y - y.mean()
    slope = (dx @ dy) / (dx @ dx)
    return y.mean() - slope * x.mean(), slope, 1.0 if freqs[0] == freqs[len(y) - 1] else (dx @ dy) ** 2 / ((dx @ dx) * (dy @ dy)), len(y)


def profiled(c: DataFrame, seeds: list[int], entropies: bool = True, curves: bool = False) -> DataFrame:
    """A row for each document of a corpus that has words, with what its words and their shuffles give; nothing is exchanged."""

    def of(ids: list[str | None], texts: list[str]) -> Iterator[tuple]:
        mixed = list(shuffled_texts([(f"{seed}:{x}" if x is not None else str(seed), t) for x, t in zip(ids, texts, strict=True) for seed in seeds]))
        for n, text in enumerate(texts):
            all_texts = [text, *mixed[n * len(seeds) : (n + 1) * len(seeds)]]
            counts = [Counter(t.split("\n")) for t in all_texts]
            freqs = sorted(counts[0].values(), reverse=True)
            h: list[float] = []
            if entropies:
                # the marks and the line end get codes with the text's own signs
                known, d = np.unique(np.concatenate([codes(text), codes("\n^$")]), return_inverse=True)
                h = [conditional_bits(np.searchsorted(known, codes(t)), len(known), *d[-3:]) for t in all_texts]
            m = max(1, len(seeds))
            yield (
                h[0] if h else None, float(len(counts[0])), sum(h[1:]) / m if h else None, sum(len(x) for x in counts[1:]) / m, *fit(freqs),
                [float(f) for f in freqs] if curves else None, sorted(map(float, counts[1].values()), reverse=True) if curves else None,
            )

    words = c.select("doc_id", F.col("doc_id").cast("string").alias("_id"), joined(F.flatten("units")).alias("_text")).filter("_text != ''")
    return mapped(words, ["_id", "_text"], _PROFILE, of)


def _fit_columns(r: DataFrame) -> DataFrame:
    """A11 of rows of ``profiled``: slope, intercept, r2 are null where fewer than five words are seen twice."""
    return r.withColumn("slope", F.round(0.0 - F.col("b"), 3)).withColumn("intercept", F.round("a", 3)).withColumn("r2", F.round("r2", 3))


def structure(c: DataFrame, seeds: list[int] = SEEDS) -> DataFrame:
    """A15-A17 of a corpus: entropy against its control, gap, and verdict."""
    return judged(profiled(c, seeds).withColumnRenamed("types", "n_types"), len(seeds))


def judged(rows: DataFrame, seeds: int = len(SEEDS)) -> DataFrame:
    """A16, A17 of h_cond, n_types, their means over a number of shuffles and the fit."""
    out = _fit_columns(rows)
    out = out.withColumn("gap", F.when(F.col("h_shuffled") != 0, (F.col("h_shuffled") - F.col("h_cond")) / F.col("h_shuffled")).otherwise(0.0) + 0.0)
    more = F.round(F.col("types_shuffled") * seeds) * 100 > 115 * seeds * F.col("n_types")  # by 15 %, in whole numbers
    like = (F.col("gap") >= 0.08) & F.col("slope").between(0.7, 1.4) & (F.col("r2") >= 0.85) & more
    verdict = F.when(F.coalesce(like, F.lit(False)), "language-like").when(F.col("gap") < 0.03, "random-like").otherwise("structured, unclear")
    return out.select("doc_id", F.round("h_cond", 3).alias("h_cond"), F.round("h_shuffled", 3).alias("h_cond_shuffled"), F.round("types_shuffled", 2).alias("types_shuffled"), (F.round("gap", 4) + 0.0).alias("structure_gap"), verdict.alias("verdict"))


def zipf(rows: DataFrame) -> DataFrame:
    """A11 of rows with a fit."""
    return _fit_columns(rows).filter("fitted_ranks >= 5").select("doc_id", "slope", "intercept", "r2", "fitted_ranks")


def per_word(rows: DataFrame) -> DataFrame:
    """A5 of rows with separator, total_signs and n_tokens."""
    return rows.select("doc_id", "separator", F.round(F.when((F.col("separator") != "none") & (F.col("n_tokens") > 0), F.col("total_signs") / F.col("n_tokens")), 4).alias("signs_per_word"))


def zipf_curve(c: DataFrame, seed: int = SEEDS[0]) -> DataFrame:
    """doc_id, series (document, shuffled, fit), rk, freq: the points of the rank-frequency plot."""
    r = _fit_columns(profiled(c, [seed], entropies=False, curves=True))
    line = F.transform(F.sequence(F.lit(1), F.col("fitted_ranks").cast("int")), lambda k: F.round(F.pow(F.lit(10.0), F.col("intercept") - F.col("slope") * F.log10(k.cast("double"))), 3))
    series = [("document", F.col("freqs")), ("shuffled", F.col("freqs_shuffled")), ("fit", F.when(F.col("slope").isNotNull(), line))]
    each = r.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("series"), x.alias("points")) for n, x in series])).alias("s"))
    points = each.select("doc_id", "s.series", F.posexplode("s.points").alias("rk", "freq"))
    return points.withColumn("rk", F.col("rk") + 1)
