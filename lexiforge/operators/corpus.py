"""Tokenising documents into units, tokens and signs (T1-T11), keyed by doc_id.

Everything is a projection of one document's row: the text is read once and nothing is exchanged. Only texts without
white space pass through a Python worker, which looks for a sign that divides words. doc_id must name a document: rows
that share one are counted as one document by all that groups by it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.text import show

#: Marks that end sentences; all of them but the middle dot and the semicolon also split text.
SENTENCE_END = ".!?।॥。！？؟;·"
SPLIT_AFTER = ".!?।॥。！？؟"
#: What a token is freed of.
MARKS = rf"[\p{{P}}{SENTENCE_END}]"
WINDOW = 12


def _bits(values: np.ndarray) -> float:
    n = np.unique(values, return_counts=True)[1] / max(len(values), 1)
    return float(-(n * np.log2(n)).sum())


def divider(body: str) -> str | None:
    """The sign of a text that behaves like a word divider: varied neighbours on both sides, hardly ever doubled."""
    codes = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), "<u4")
    signs, first, count = np.unique(codes[codes != 10], return_index=True, return_counts=True)
    rank = np.lexsort((first, -count))
    common = [signs[i] for i in rank[:15] if count[i] >= 10]
    scores = []
    for nth, sign in enumerate(common):
        at = np.flatnonzero(codes == sign)
        sides = _bits(codes[at[at > 0] - 1]) + _bits(codes[at[at < len(codes) - 1] + 1])
        runs = np.diff(np.concatenate([[-1], np.flatnonzero(np.diff(at) != 1), [len(at) - 1]]))
        scores.append((sides, -nth, nth < 6 and (runs // 2).sum() / len(at) < 0.02))
    best = max((x for x in scores if x[2]), default=None)
    others = [x[0] for x in scores if x is not best]
    return chr(common[-best[1]]) if best and others and best[0] > max(others) * 1.05 else None



def _dividers(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in bodies:
        yield batch.map(lambda x: None if x is None else divider(x))


def corpus(docs: DataFrame, glyph_mode: bool = False) -> DataFrame:
    """doc_id, raw, has_case, separator, sentence_marks, unit_kind, units (arrays of tokens) of documents (doc_id, text)."""
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("raw")).withColumn("body", F.replace("raw", F.lit("\r"), F.lit("")))
    flat = F.replace("body", F.lit("\n"), F.lit(""))
    body = body.select(
        "*",
        ((F.char_length(flat) - F.char_length(F.regexp_replace(flat, r"(?U)\s+", ""))) / F.greatest(F.lit(1), F.char_length(flat)) >= 0.03).alias("spaced"),
        (F.col("body").rlike(r"\p{Lu}") & F.col("body").rlike(r"\p{Ll}")).alias("has_case"),
        (F.col("body").rlike(rf"[\p{{Po}}{SENTENCE_END}](?:[^\p{{Po}}{SENTENCE_END}]*+[\p{{Po}}{SENTENCE_END}]){{2}}") & F.lit(not glyph_mode)).alias("sentence_marks"),
    )
    body = body.withColumn("sep", F.pandas_udf(_dividers, "string")(F.when(~F.col("spaced"), F.col("body"))))
    row = F.struct("spaced", "sep", "has_case", "sentence_marks", "body")
    body = body.withColumn("units", once(row, _units(glyph_mode)))
    single = (F.size("units") <= 1) & (F.size(F.flatten("units")) > 60)
    return body.select(
        "doc_id", "raw", "has_case", "sentence_marks",
        F.when(F.col("spaced"), "whitespace").when(F.col("sep").isNotNull(), F.concat(F.lit("sign "), "sep")).otherwise("none").alias("separator"),
        F.when(single, f"{WINDOW}-token window").when(F.col("sentence_marks"), "sentence").otherwise("line").alias("unit_kind"),
        F.when(single, _windows(F.flatten("units"))).otherwise(F.col("units")).alias("units"),
    )


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, where f uses it inside functions over arrays: else it would be computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _units(glyph_mode: bool) -> Callable[[Column], Column]:
    """The units of a row (spaced, sep, has_case, sentence_marks, body), each an array of tokens."""

    def units(row: Column) -> Column:
        lines = F.filter(F.split(row["body"], "\n", -1), lambda x: x.rlike(r"(?U)\S"))
        chunks = F.when(row["sentence_marks"], F.split(F.array_join(lines, " "), rf"(?U)(?<=[{SPLIT_AFTER}])\s+")).otherwise(lines)

        def words(chunk: Column) -> Column:
            parts = (
                F.when(row["sep"].isNotNull(), F.split(F.replace(chunk, F.lit(" "), F.lit("")), F.concat(F.lit(r"\Q"), row["sep"], F.lit(r"\E"))))
                .otherwise(F.split(F.regexp_replace(chunk, r"(?U)\s", ""), ""))
            )
            bare = F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$" if glyph_mode else rf"(?U){MARKS}|^\s+|\s+$", ""))
            cased = F.transform(bare, lambda p: F.when(row["has_case"], F.lower(p)).otherwise(p))
            # between blanks no mark divides words, so they go from a whole chunk at once
            text = chunk if glyph_mode else F.regexp_replace(chunk, rf"(?U){MARKS}", "")
            spaced = F.split(F.when(row["has_case"], F.lower(text)).otherwise(text), r"(?U)\s+")
            return F.filter(F.when(row["spaced"], spaced).otherwise(cased), lambda p: p != "")

        return F.filter(F.transform(chunks, words), lambda u: F.size(u) > 0)

    return units


def _windows(tokens_: Column) -> Column:
    """Tokens in runs of WINDOW. They are joined with marks that no text has and split at those, as slices would copy the array each."""
    marked = F.transform(tokens_, lambda t, i: F.concat(t, F.when(i % WINDOW == WINDOW - 1, F.lit("\ufdd1")).otherwise(F.lit("\ufdd0"))))
    runs = F.filter(F.split(F.array_join(marked, ""), "\ufdd1"), lambda r: r != "")
    return F.transform(runs, lambda r: F.filter(F.split(r, "\ufdd0"), lambda t: t != ""))


def tokens(c: DataFrame) -> DataFrame:
    """doc_id, unit_idx, pos (in the unit), unit_len, tok_idx, token of a corpus; nothing is exchanged."""
    placed = F.flatten(F.transform("units", lambda u, i: F.transform(u, lambda t, p: F.struct(i.alias("unit_idx"), p.alias("pos"), F.size(u).alias("unit_len"), t.alias("token")))))
    return c.select("doc_id", F.posexplode(placed).alias("tok_idx", "x")).select("doc_id", "x.unit_idx", "x.pos", "x.unit_len", "tok_idx", "x.token")


def words_of(c: DataFrame) -> Column:
    """The tokens of a corpus' row in the order of the text."""
    return F.flatten("units")


def notes(c: DataFrame) -> DataFrame:
    """doc_id, seq, note: caveats about dividers and units."""
    found = F.array_compact(F.array(
        F.when(F.startswith("separator", F.lit("sign ")), F.concat(F.lit("there is no white space; the "), "separator", F.lit(" is taken as the word divider"))),
        F.when(F.col("separator") == "none", F.lit("there is no word divider; each sign is a token")),
        F.when(F.startswith("unit_kind", F.lit(f"{WINDOW}-")), F.lit(f"there are neither sentences nor lines; units are runs of {WINDOW} tokens")),
    ))
    return c.select("doc_id", F.posexplode(found).alias("seq", "note"))


def first_units(k: int = 3) -> Column:
    """The first k units of a corpus' row as they are shown."""
    return F.transform(F.slice("units", 1, k), lambda u: F.array_join(F.transform(u, lambda t: show(t)), " "))


def sample(c: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, unit_idx, unit: the first k units as they are shown."""
    u = c.select("doc_id", F.posexplode(F.slice("units", 1, k)).alias("unit_idx", "u"))
    return u.select("doc_id", "unit_idx", F.array_join(F.transform("u", lambda t: show(t)), " ").alias("unit"))


def signs(t: DataFrame) -> DataFrame:
    """doc_id, tok_idx, sign_in_tok, sign of tokens."""
    return t.select("doc_id", "tok_idx", F.posexplode(F.split("token", "")).alias("sign_in_tok", "sign")).filter("sign != ''")
