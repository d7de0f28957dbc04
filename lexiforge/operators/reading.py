"""All that the four methods find in one document, in one pass over its row.

What is found looks at one document's words at a time, so a row of the corpus goes through Python once and nothing is
exchanged. The operators of ``statistics``, ``structure``, ``findings`` and ``compare`` do the same to tables of tokens.
The orders of a document's signs are made once for each seed and serve every shuffle that asks for them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.operators.batches import mapped
from lexiforge.operators.detection import _PROFILE as SCRIPTS
from lexiforge.operators.detection import kinds
from lexiforge.operators.shuffle import codes, orders
from lexiforge.operators.statistics import SEEDS, conditional_bits, fit
from lexiforge.operators.wordforms import CONTROL_SEED, FOUND, Words, control_key, digits_of, forms_of, text_of

#: Signs of the texts whose orders are held at a time; a longer text is held alone.
SIGNS = 100_000
#: Signs of a rank profile.
RANKS = 60
#: Affixes that are listed.
AFFIXES = 12
_AFFIX = "array<struct<affix: string, score: bigint>>"
READ = (
    f"scripts array<struct<script: string, letters: bigint>>, {SCRIPTS}, total_signs bigint, distinct_signs bigint, hapax_signs bigint, twice bigint, h1 double, "
    "n_tokens bigint, n_types bigint, h_word double, h_cond double, h_shuffled double, types_shuffled double, a double, b double, r2 double, fitted_ranks bigint, "
    "shares array<double>, dividers array<struct<sign: string, alone: bigint>>, numerals array<struct<sign: string, c: bigint, kind: string>>, "
    "number_words array<struct<token: string, side: string, c: bigint, lift: double>>, "
    "positions array<struct<side: string, rk: int, token: string, c: bigint, share: double, ratio: double>>, "
    f"cased array<struct<name: string, c: bigint>>, endings {_AFFIX}, beginnings {_AFFIX}, {FOUND}"
)
NEAR = "n bigint, control_n bigint, found array<struct<lang: string, hits: bigint, control: bigint, examples: array<string>>>"
#: A word of a text that begins with a capital, not after the end of a sentence.
CAPITALISED = r'(?U)(?<=[^.!?:"\s])\s+([^\p{L}\p{N}_\s]*\p{Lu}\p{Ll}\S*)'


def rounded(x: float, digits: int) -> float:
    """What ``statistics.rounded`` makes of x, which is not below zero."""
    whole, part = divmod(x * 10.0**digits, 1)
    return (whole + (part >= 0.5)) / 10.0**digits


def decimally(x: float, digits: int) -> float:
    """What F.round makes of x: by its decimal form."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def entropy(counts: np.ndarray) -> float | None:
    """F13."""
    n = counts.sum()
    return float(np.log2(n) - (counts * np.log2(counts)).sum() / n) if n else None


def positions(units: list[list[str]]) -> list[tuple[str, int, str, int, float, float]]:
    """Words tied to the first or last place of units of three tokens: 2.5 times chance, five uses; the first 8 of each side."""
    long = [u for u in units if len(u) >= 3]
    if not long:
        return []
    uses = Counter(chain.from_iterable(long))
    base = len(long) / uses.total()
    out, place = [], None
    for side, at in (("first", 0), ("last", -1)):
        some = []
        for w, h in Counter([u[at] for u in long]).items():
            if (c := uses[w]) >= 5 and (ratio := h / c / base) >= 2.5:
                place = place or {x: i for i, x in enumerate(uses)}
                r = rounded(ratio, 1)
                some.append((-rounded(r * float(np.log1p(c)), 9), place[w], (w, c, rounded(h / c, 2), r)))
        out += [(side, rk, *x) for rk, (_, _, x) in enumerate(sorted(some)[:8], 1)]
    return out


def number_words(d: Words, counts: Counter[str]) -> list[tuple[str, str, int, float]]:
    """Words next to numbers three times and three times more often than by chance; the first 8 by count times lift."""
    if not d.numbers:
        return []
    before: Counter[str] = Counter()
    after: Counter[str] = Counter()
    for u in d.units:
        if not d.numbers.isdisjoint(u):
            for x, y in zip(u, u[1:], strict=False):
                if y in d.numbers and x not in d.numbers:
                    before[x] += 1
                elif x in d.numbers and y not in d.numbers:
                    after[y] += 1
    n_num, some, place = sum(counts[w] for w in d.numbers), [], {w: i for i, w in enumerate(counts)}
    for nth, (side, beside) in enumerate((("before", before), ("after", after))):
        for w, c in beside.items():
            if c >= 3 and (lift := c / (n_num * counts[w] / len(d.tokens))) >= 3:
                lift = decimally(lift, 1)
                some.append((-c * lift, nth, place[w], (w, side, c, lift)))
    return [x[3] for x in sorted(some)[:8]]


def cased(names: str | None, lows: str | None, counts: Counter[str]) -> list[tuple[str, int]]:
    """Names that occur twice at least and are rare in lower case; the first 12 of 40. ``lows`` are the names in lower case."""
    if not names:
        return []
    each = names.split("\n")
    low = dict(zip(each, lows.split("\n"), strict=True))
    top = sorted(Counter(each).items(), key=lambda x: -x[1])[:40]  # the sort is stable: of equal counts the first seen
    return [(w, c) for w, c in top if c >= 2 and counts[low[w]] * 10 <= c * 12][:12]


def _script(raw: str) -> tuple:
    by_script: Counter[str] = Counter()
    sides: Counter[str | None] = Counter()
    for script, side, c in kinds(raw):
        by_script[script] += c
        sides[side] += c
    top = max(((c, s) for s, c in by_script.items()), default=(0, None))[1]
    return list(by_script.items()), by_script.total(), top, by_script["PRIVATE-USE"], by_script["UNASSIGNED"], sides["rtl"], sides["ltr"]


def _dealt(c: np.ndarray, at: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = c.copy()
    out[at] = c[at][order]
    return out


def _text(c: np.ndarray) -> str:
    return c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _one(name: str | None, raw: str, d: Words, spaced: bool, shuffles: list[np.ndarray], names: str | None, lows: str | None) -> tuple[tuple, str]:
    """READ of a document, and its text shuffled by the first seed."""
    counts = Counter(d.tokens)
    signs = Counter("".join(d.tokens))
    c = np.array(list(signs.values()), float)
    text = codes("\n".join(d.tokens))
    at = np.flatnonzero(text != 10)
    h, types, a, b, r2, ranks, mixed = [None], [], None, None, None, None, ""
    if d.tokens:
        # the marks and the line end get numbers with the text's own signs
        known, x = np.unique(np.concatenate([text, codes("\n^$")]), return_inverse=True)
        x, marks = x[:-3], x[-3:]
        mixes = [_dealt(text, at, o) for o in shuffles]
        h = [conditional_bits(y, len(known), *marks) for y in (x, *[_dealt(x, at, o) for o in shuffles])]
        mixed = _text(mixes[0])
        types = [len(set(mixed.split("\n"))), *[len(set(_text(m).split("\n"))) for m in mixes[1:]]]
        a, b, r2, ranks = fit(sorted(counts.values(), reverse=True))
    control = None
    if spaced and len(set(d.words)) >= 20:
        order = shuffles[SEEDS.index(CONTROL_SEED)]
        words = codes("\n".join(d.words)) if d.numbers else text
        inside = np.flatnonzero(words != 10) if d.numbers else at
        control = _text(_dealt(words, inside, order[order < len(inside)] if d.numbers else order))  # fewer places keep their order
    forms, ends = forms_of(d, control_key(name), control, True, True, AFFIXES)
    digits = [(s, signs[s], "digit" if s in d.digits else "tally") for s in d.numerals]
    single = [(w, n) for w, n in counts.items() if len(w) == 1 and n >= 5 and n / signs[w] >= 0.8] if spaced else []
    shares = np.sort(c)[::-1][:RANKS] / max(c.sum(), 1)
    return (
        *_script(raw), int(c.sum()), len(c), int((c == 1).sum()), int((c == 2).sum()), entropy(c), len(d.tokens), len(counts), entropy(np.array(list(counts.values()), float)),
        h[0], sum(h[1:]) / len(SEEDS) if h[1:] else None, sum(types) / len(SEEDS) if types else None, a, b, r2, ranks,
        [*(rounded(float(s), 9) for s in shares), *[0.0] * (RANKS - len(shares))], single, digits, number_words(d, counts), positions(d.units), cased(names, lows, counts), *ends, *forms,
    ), mixed


def read(c: DataFrame, near: Callable[[list[str], list[str]], list[tuple]] | None = None) -> DataFrame:
    """READ of a corpus with names and lows (``with_names``), besides its other columns but raw and units; with ``near`` also NEAR.

    ``near`` makes NEAR of lists of texts and their shuffles, words divided by line ends. A row for each document.
    """

    def group(rows: list[tuple]) -> Iterator[tuple]:
        n = [sum(map(len, d.tokens)) for _, _, d, *_ in rows]
        wanted = iter(orders((f"{seed}:{name}" if name is not None else str(seed), k) for (name, *_), k in zip(rows, n, strict=True) for seed in SEEDS))
        made = [_one(name, raw, d, spaced, [next(wanted) for _ in SEEDS], names, lows) for name, raw, d, spaced, names, lows in rows]
        more = near(["\n".join(r[2].tokens) for r in rows], [m for _, m in made]) if near else [()] * len(rows)
        yield from ((*x, *y) for (x, _), y in zip(made, more, strict=True))

    def of(ids: list[str | None], raws: list[str], texts: list[str], spaced: list[bool], digits: list[list[str]], names: list[str | None], lows: list[str | None]) -> Iterator[tuple]:
        rows, size = [], 0
        for name, raw, text, s, dd, nn, ll in zip(ids, raws, texts, spaced, digits, names, lows, strict=True):
            if rows and size + len(text) > SIGNS:
                yield from group(rows)
                rows, size = [], 0
            rows.append((name, raw, Words.of(text, dd), s, nn, ll))
            size += len(text)
        if rows:
            yield from group(rows)

    rows = c.withColumn("_id", F.col("doc_id").cast("string")).withColumn("_text", text_of(F.col("units"))).withColumn("n_units", F.size("units")).drop("units")
    rows = rows.withColumn("_spaced", F.col("separator") != "none").withColumn("_digits", digits_of(F.col("_text"))).withColumnRenamed("names", "_names")
    return mapped(rows, ["_id", "raw", "_text", "_spaced", "_digits", "_names", "lows"], f"{READ}, {NEAR}" if near else READ, of)


def with_names(c: DataFrame) -> DataFrame:
    """A corpus with names, the capitalised words inside its sentences (null without both cases), and lows, these in lower case; a line each."""
    bare = lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")
    names: Column = F.when(F.col("has_case"), F.array_join(F.transform(F.regexp_extract_all("raw", F.lit(CAPITALISED), F.lit(1)), bare), "\n"))
    return c.withColumn("names", names).withColumn("lows", F.lower("names"))
