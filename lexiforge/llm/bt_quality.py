"""Document quality by Bradley-Terry pairwise ranking.

A labelled good document is preferred to a labelled bad one. The weights of a linear score are learnt by
logistic loss on the feature differences of such preference pairs; the decision threshold is the quantile of
all labelled documents' scores that leaves the labelled share of bad documents below it. Scores of new documents are
the logistic of their distance from that threshold, so 0.5 is the threshold.

Features are shares and ratios of the whole text alone (bytes of each kind, words, lines); labels, language,
source and ids are no inputs. The weights are learnt from a bounded sample of the labelled rows (``max_labelled`` of
each class, the smallest hashes of their ids). Where that leaves rows out, a further pass finds the strengths of all labelled
rows, the threshold is their exact quantile and the slope weights the sampled classes by their full counts. Scoring
reads every row once, without an exchange.

Defined results: null text counts as empty; the empty text has all features 0 and gets the score that the
model gives those; ties and repeated rows score alike; with no pair to learn from (no labels of one class)
every score is 1.0 and nothing is rejected; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import materialise, trim

FEATURES = (
    "log_bytes", "upper", "digit", "space", "newline", "non_ascii", "sentence_marks", "commas", "other_marks", "pipe",
    "exclamation", "distinct_words", "mean_word", "sd_word", "top_word", "repeated_lines", "upper_words", "stop_like", "one_byte_words",
)
_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t", "newline": b"\n",
    "sentence_marks": b".?", "commas": b",;:", "other_marks": b"#$%&*@^~<>=+_/\\{}[]()\"'`-", "pipe": b"|", "exclamation": b"!",
}


def _kind_matrix() -> np.ndarray:
    m = np.zeros((256, 10))
    for j, marks in enumerate(_KINDS.values()):
        m[list(marks), j] = 1
    m[128:, 9] = 1
    return m


_MATRIX = _kind_matrix()


def features(text: str) -> np.ndarray:
    """The feature vector of one text, in the order of FEATURES."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return np.zeros(len(FEATURES))
    share = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _MATRIX) / n
    upper, digit, space, newline, stops, commas, other, pipe, bang, high = share
    words = raw.split()
    w = max(1, len(words))
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = raw.split(b"\n")
    return np.array([
        np.log1p(n) / 10, upper, digit, space, newline, high, stops, commas, other, pipe,
        bang, len(counts) / w, sizes.mean() / 10, sizes.std() / 10, max(counts.values(), default=0) / w,
        1 - len(set(lines)) / len(lines), sum(map(bytes.isupper, counts)) / max(1, len(counts)),
        np.count_nonzero(sizes <= 3) / w, np.count_nonzero(sizes == 1) / w,
    ])


@dataclass
class BradleyTerry:
    """score(x) = 1 / (1 + exp(-slope * (w . (x - mean) / scale - threshold)))."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(FEATURES)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    threshold: float = -50.0
    slope: float = 1.0
    pairs: int = 0

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strength(x) - self.threshold), -60, 60)))


def train(good: np.ndarray, bad: np.ndarray, pairs_per_row: int = 20, ridge: float = 1e-3, seed: int = 7) -> BradleyTerry:
    """Fit by Newton's method on -mean log sigma(w . (x_good - x_bad)) + ridge |w|^2 / 2."""
    if not len(good) or not len(bad):
        return BradleyTerry()
    both = np.vstack([good, bad])
    model = BradleyTerry(mean=both.mean(0), scale=np.maximum(both.std(0), 1e-6))
    g, b = (np.clip((x - model.mean) / model.scale, -8, 8) for x in (good, bad))
    rng = np.random.default_rng(seed)
    n = pairs_per_row * max(len(g), len(b))
    diff = g[rng.permutation(n) % len(g)] - b[rng.permutation(n) % len(b)]
    w = np.zeros(diff.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -60, 60)))
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / n + ridge * np.eye(len(w)), diff.T @ p / n - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    model.weights, model.pairs = w, n
    ranked = np.sort(np.concatenate([g @ w, b @ w]))
    cut = len(b)  # the quantile of the share of bad rows: the middle of the gap between the ranks about it
    model.threshold = float((ranked[cut - 1] + ranked[cut]) / 2)
    model.slope = slope(g @ w - model.threshold, b @ w - model.threshold)
    return model


def slope(good: np.ndarray, bad: np.ndarray, n_good: int = 0, n_bad: int = 0) -> float:
    """By logistic loss on strengths less the threshold; the rows stand for n_good and n_bad rows (0: for themselves)."""
    centred, is_good = np.concatenate([good, bad]), np.arange(len(good) + len(bad)) < len(good)
    weight = np.where(is_good, (n_good or len(good)) / len(good), (n_bad or len(bad)) / len(bad))
    weight /= weight.mean()
    out = 1.0
    for _ in range(60):
        p = 1 / (1 + np.exp(np.clip(-out * centred, -60, 60)))
        grad, curve = (weight * (is_good - p) * centred).mean() - 1e-4 * out, (weight * p * (1 - p) * centred**2).mean() + 1e-4
        out = float(np.clip(out + grad / curve, 0.05, 50))
    return out


def order_statistic(rows: DataFrame, column: str, rank: int) -> float:
    """The value of the given rank (from 0): counts in 4096 ranges, of which the one with the rank is divided in turn."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low < high:
        part = F.least(F.floor((F.col(column) - low) / ((high - low) / 4096)), F.lit(4095))
        for r in rows.filter(F.col(column).between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy("part").collect():
            if rank < r["n"]:
                low, high = r["low"], r["high"]
                break
            rank -= r["n"]
    return low


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"good": b["good"], "x": [features(t) for t in b["content"]]})
        trim()


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_labelled: int = 8000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> BradleyTerry:
    """Learn from labelled documents for which ``learn`` holds (a condition on the labels' id column ``key``).

    At most max_labelled rows of each class give the weights, so what is broadcast and collected has that bound; all
    labelled rows give the threshold.
    Where a document has several labels, it counts as good if any label is 1.
    """
    marked = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("good")).filter("key IS NOT NULL AND good IN (0, 1)")
    marked = (marked.filter(learn) if learn is not None else marked).groupBy("key").agg(F.max("good").alias("good"))
    # a bounded number of each class, whatever the table's size: the first by hash
    parts = [marked.filter(F.col("good") == v).orderBy(F.xxhash64(F.col("key")), "key").limit(max_labelled) for v in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("content")).join(F.broadcast(sample), "key")
    found = rows.select("good", "content").mapInPandas(_vectors, "good int, x array<double>").orderBy("x").limit(2 * max_labelled).collect()
    x = [np.array([r["x"] for r in found if r["good"] == v]).reshape(-1, len(FEATURES)) for v in (0, 1)]
    model = train(x[1], x[0])
    if model.pairs and marked.groupBy("good").count().filter(F.col("count") > max_labelled).count():
        _to_all_labelled(model, docs, marked, x[1], x[0], id_col, text_col)
    return model


def _to_all_labelled(model: BradleyTerry, docs: DataFrame, marked: DataFrame, good: np.ndarray, bad: np.ndarray, id_col: str, text_col: str) -> None:
    """Set the threshold and slope to those of all rows of marked (key, good); good, bad: the sample's vectors."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("key"), _each(model.strength)(F.coalesce(F.col(text_col), F.lit(""))).alias("s"))
    rows = materialise(spark, rows.join(marked, "key").select("good", "s"), "labelled-strengths")
    counts = {r["good"]: r["count"] for r in rows.groupBy("good").count().collect()}
    cut = counts[0]
    below = order_statistic(rows, "s", cut - 1)
    upto, above = rows.agg(F.count_if(F.col("s") <= below), F.min(F.when(F.col("s") > below, F.col("s")))).first()
    model.threshold = float((below + (below if upto > cut else above)) / 2)
    model.slope = slope(model.strength(good) - model.threshold, model.strength(bad) - model.threshold, counts[1], counts[0])


def _each(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """f of the feature vectors of texts as a column."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(f(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))))
            trim()

    return of


def score(docs: DataFrame, model: BradleyTerry, text_col: str = "text", score_col: str = "bt_score") -> DataFrame:
    """docs with a further column score_col, which replaces one of that name; one narrow pass."""
    return docs.withColumn(score_col, _each(model.score)(F.coalesce(F.col(text_col), F.lit(""))))
