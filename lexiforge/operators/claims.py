"""What the methods claim of each document, labelled as measured, inferred or guessed.

A claim is a row (doc_id, method, seq, label, text). Every figure comes from the operators; here they are only put into words,
one narrow projection for each table of findings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.text import claim, language_name, show
from lexiforge.operators import compare as co
from lexiforge.operators import corpus as oc
from lexiforge.operators import detection as dt
from lexiforge.operators import findings as fi
from lexiforge.operators import reading as rd
from lexiforge.operators import statistics as st
from lexiforge.operators.staging import staged

OBSERVED, INFERRED, HYPOTHESIS = "OBSERVED", "INFERRED", "HYPOTHESIS"


@dataclass
class Findings:
    """The tables of one analysis, each keyed by doc_id."""

    corpus: DataFrame
    rows: DataFrame
    tokens: DataFrame
    inventory: DataFrame
    per_word: DataFrame
    words: DataFrame
    zipf: DataFrame
    verdict: DataFrame
    scripts: DataFrame
    direction: DataFrame
    dividers: DataFrame
    affixes: DataFrame
    endings: DataFrame
    beginnings: DataFrame
    signatures: DataFrame
    functions: DataFrame
    order: DataFrame
    positions: DataFrame
    numerals: DataFrame
    number_words: DataFrame
    names: DataFrame
    closest: DataFrame | None = None
    lexical: DataFrame | None = None
    deciphered: DataFrame | None = None


def find(docs: DataFrame, lex: DataFrame | None = None, decipher: list[str] | None = None, iterations: int = 6000, units: bool = False) -> Findings:
    """All findings of documents (doc_id, text); the comparison needs a lexicon, the search for sign values also languages.

    A document's row is read once (``reading``) and what is found is staged, a row for each document; with ``units`` the corpus is staged too.
    """
    whole = rd.with_names(oc.corpus(docs.select("doc_id", "text")))
    whole = staged(whole) if units or decipher else whole
    index = None if lex is None else staged(co.deletion_index(lex))
    near = co.meeting(index) if index is not None and co.travels(index) else None
    r = staged(rd.read(whole.select("doc_id", "raw", "has_case", "separator", "unit_kind", "units", "names", "lows"), near))
    c, said = whole.drop("raw", "names", "lows"), r.filter("n_tokens > 0")
    each = lambda column: r.select("doc_id", F.posexplode(column).alias("rk", "x")).select("doc_id", (F.col("rk") + 1).alias("rk"), "x.*")
    affixes = fi.affix_control(r)
    shares = r.select("doc_id", "letters", F.explode("scripts").alias("x")).select("doc_id", "x.script", "x.letters", F.round(F.col("x.letters") / F.col("letters"), 4).alias("share"))
    names = r.withColumn("names", F.when(F.col("has_case"), F.transform("cased", lambda x: F.struct(x["name"].alias("token"), x["c"].alias("c")))).otherwise(F.col("names")))
    names = names.select("doc_id", F.posexplode("names").alias("rk", "x")).select("doc_id", (F.col("rk") + 1).alias("rk"), F.col("x.token").alias("word"), "x.c")
    out = Findings(
        c, r, oc.tokens(c), st.inventory(said), st.per_word(r), _words(said), st.zipf(said), st.judged(said), shares, r.select("doc_id", *dt.profile_columns()), each("dividers"), affixes, each("endings"), each("beginnings"),
        fi.controlled_signatures(c, c, r), fi.function_words(r), fi.word_order(r), r.select("doc_id", F.explode("positions").alias("x")).select("doc_id", "x.*"), each("numerals"), each("number_words"), names,
    )
    if lex is not None:
        profiles, references = co.read_profile(said), co.reference_profiles(lex)
        ranked = staged(co.closest(profiles, references, None))
        readable = out.direction.filter("unknown_share < 0.2 AND letters > 0").select("doc_id")
        languages = co.compared_languages(ranked).join(readable, "doc_id", "left_semi")
        out.closest = ranked.filter("rk <= 6")
        out.lexical = staged(co.lexical_matching(c, languages, index, met=r.select("doc_id", "n", "control_n", "found") if near else None))
        if decipher:
            out.deciphered = staged(co.decipher(c, decipher, staged(co.letter_counts(lex)), lex, iterations))
    return out


def _words(r: DataFrame) -> DataFrame:
    """A10, A12 of rows that were read."""
    return r.select("doc_id", F.col("n_tokens").alias("tokens"), F.col("n_types").alias("types"), F.round(F.col("n_types") / F.col("n_tokens"), 4).alias("ttr"), F.round(F.col("total_signs") / F.col("n_tokens"), 4).alias("mean_length"), F.round(F.round("h_word", 12) + 0.0, 4).alias("h_word"))


def text_of(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def percent(share: Column) -> Column:
    return text_of(F.round(share * 100).cast("int"), " %")


def _said(rows: DataFrame, method: str, seq: int, label: str, text: Column) -> DataFrame:
    x = rows.select("doc_id", F.lit(method).alias("method"), F.lit(seq).alias("seq"), claim(label, text).alias("x"))
    return x.select("doc_id", "method", "seq", "x.label", "x.text").filter("text IS NOT NULL")


def _listed(rows: DataFrame, item: Column, order: str, k: int) -> DataFrame:
    """doc_id, items: the first k items of each document in one text."""
    x = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("t")))).alias("x"))
    return x.select("doc_id", F.array_join(F.transform(F.slice("x", 1, k), lambda s: s["t"]), ", ").alias("items"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _worded(word: str, count: str) -> Column:
    return text_of(show(F.col(word)), " (", F.col(count), ")")


def inventory_claims(f: Findings) -> DataFrame:
    """What Method 1 claims of signs, words and the kind of writing."""
    m = "inventory"
    i = f.inventory.join(f.per_word, "doc_id")
    mixed = f.scripts.withColumn("nth", -F.col("letters"))
    kinds = _listed(mixed, text_of(F.initcap("script"), " ", percent(F.col("share"))), "nth", 4)
    alone = _listed(f.dividers.withColumn("nth", -F.col("alone")), _worded("sign", "alone"), "nth", 6)
    seen = f.direction.select("doc_id", "direction")
    return _all([
        _said(kinds, m, 1, OBSERVED, text_of("letters by script: ", F.col("items"))),
        _said(i, m, 2, OBSERVED, text_of(F.col("total_signs"), " signs, ", F.col("distinct_signs"), " of them different, ", F.col("hapax_signs"), " seen once")),
        _said(i, m, 3, INFERRED, text_of("an inventory of about ", F.round("chao1_inventory").cast("int"), " signs by Chao's estimate; the next sign would be a new one with probability ", F.col("unseen_mass"))),
        _said(f.rows, m, 4, OBSERVED, text_of("words are divided by: ", F.col("separator"), "; units are of the kind ", F.col("unit_kind"), ", ", F.col("n_units"), " in number")),
        _said(oc.notes(f.rows), m, 5, INFERRED, F.col("note")),
        _said(alone, m, 6, INFERRED, text_of("signs that nearly always are a word of their own, such as numerals or marks: ", F.col("items"))),
        _said(seen.filter("direction IS NOT NULL"), m, 7, OBSERVED, text_of("its characters are written ", F.col("direction"))),
        _said(seen.filter("direction IS NULL"), m, 7, INFERRED, F.lit("the characters have no direction of their own; the order of the file is taken")),
        _said(i, m, 8, INFERRED, text_of("the writing is of the kind ", F.col("system_type"), F.when(F.col("signs_per_word").isNotNull(), text_of(", with ", F.round("signs_per_word", 1), " signs to a word")).otherwise(F.lit("")))),
    ])


def statistics_claims(f: Findings) -> DataFrame:
    """What Method 2 claims of frequencies and order."""
    m = "statistics"
    w = f.words.join(f.inventory.select("doc_id", "h1", "distinct_signs"), "doc_id").join(f.verdict, "doc_id").join(f.zipf, "doc_id", "left")
    fit = F.when(F.col("slope").isNotNull(), text_of("word frequencies fall with rank by a slope of ", F.col("slope"), ", R2 ", F.col("r2"), ", over ", F.col("fitted_ranks"), " words seen twice")).otherwise(F.lit("too few repeated words for a curve of frequencies"))
    meaning = F.when(F.col("verdict") == "language-like", "order and repetition are those of a language, or of a simple cipher of one").when(F.col("verdict") == "random-like", "signs are in an order that a shuffle would give").otherwise("there is order, but not that of running text")
    return _all([
        _said(w, m, 1, OBSERVED, text_of(F.col("tokens"), " words, ", F.col("types"), " of them different (", F.round("ttr", 2), "), ", F.round("mean_length", 2), " signs long in the mean")),
        _said(w, m, 2, OBSERVED, text_of("a sign carries ", F.round("h1", 2), " bits, after the sign before it ", F.round("h_cond", 2), " bits; after a shuffle ", F.round("h_cond_shuffled", 2), " bits")),
        _said(w, m, 3, OBSERVED, text_of("a word carries ", F.round("h_word", 2), " bits")),
        _said(w, m, 4, OBSERVED, fit),
        _said(w, m, 5, OBSERVED, text_of("shuffles make ", F.round("types_shuffled").cast("int"), " different words instead of ", F.col("types"))),
        _said(w, m, 6, INFERRED, text_of("the text is ", F.col("verdict"), ": ", meaning)),
        _said(w, m, 7, HYPOTHESIS, F.lit("a straight curve of frequencies alone proves no language, as random strings with blanks have one too")),
    ])


def structure_claims(f: Findings) -> DataFrame:
    """What Method 3 claims of word forms, order, numbers and names."""
    m = "structure"
    few = f.rows.select("doc_id").join(f.affixes.select("doc_id"), "doc_id", "left_anti")
    n = F.col("before") + F.col("after")
    hint = f.order.filter("hint IS NOT NULL")
    both = hint.join(f.affixes.filter("side IS NOT NULL").select("doc_id", "side"), "doc_id")
    last = f.positions.filter("side = 'last'")
    ends = {s: _listed(f.positions.filter(F.col("side") == s), text_of(show(F.col("token")), " (", F.col("c"), ", ", F.col("ratio"), " x chance)"), "rk", 5) for s in ("first", "last")}
    beside = f.number_words.filter("rk <= 5")
    sets = f.signatures.filter("rk <= 5").withColumn("forms", F.array_join(F.transform(F.split("endings", r"\|", -1), lambda e: F.when(e == "", "(bare)").otherwise(F.concat(F.lit("-"), show(e)))), ", "))
    return _all([
        _said(few, m, 1, OBSERVED, F.lit("too few different words, or no word boundaries, for a study of word forms")),
        _said(f.affixes, m, 1, OBSERVED, text_of("endings score ", F.col("suffix"), " and beginnings ", F.col("prefix"), "; words of shuffled signs score ", F.col("control_suffix"), " and ", F.col("control_prefix"))),
        _said(f.affixes.filter("NOT significant"), m, 2, INFERRED, F.lit("endings and beginnings are no more regular than in a shuffle")),
        _said(_listed(f.endings, text_of("-", show(F.col("affix")), " (", F.col("score"), ")"), "rk", 8), m, 3, OBSERVED, text_of("endings on most stems: ", F.col("items"))),
        _said(_listed(f.beginnings, text_of(show(F.col("affix")), "- (", F.col("score"), ")"), "rk", 8), m, 4, OBSERVED, text_of("beginnings on most stems: ", F.col("items"))),
        _said(sets, m, 5, INFERRED, text_of(F.col("stems"), " stems share the endings ", F.col("forms"), ", such as ", F.array_join(F.transform("examples", lambda e: show(e)), ", "), "; such sets are inflection")),
        _said(f.affixes.filter("side IS NOT NULL"), m, 6, INFERRED, text_of("the language looks ", F.col("side"))),
        _said(_listed(f.functions, _worded("token", "c"), "rk", 10), m, 7, INFERRED, text_of("words that may be function words: ", F.col("items"))),
        _said(ends["first"], m, 8, OBSERVED, text_of("words tied to the start of a unit: ", F.col("items"))),
        _said(ends["last"], m, 9, OBSERVED, text_of("words tied to the end of a unit: ", F.col("items"))),
        _said(hint, m, 10, HYPOTHESIS, text_of("function words stand before another word in ", percent(F.col("before") / n), " of the cases; ", F.col("hint"), " languages do so")),
        _said(both, m, 11, HYPOTHESIS, F.when(((F.col("hint") == "head-final") & (F.col("side") == "suffixing")) | ((F.col("hint") == "head-initial") & (F.col("side") == "prefixing")), "word order and side of affixes go together as in most languages").otherwise("word order and side of affixes do not go together as in most languages")),
        _said(_listed(last.join(hint.filter("hint = 'head-final'").select("doc_id"), "doc_id", "left_semi"), show(F.col("token")), "rk", 4), m, 12, HYPOTHESIS, text_of("in such languages words at the end of a unit are often verbs: ", F.col("items"))),
        _said(_listed(f.numerals.withColumn("nth", -F.col("c")), text_of(show(F.col("sign")), " (", F.col("c"), ", ", F.col("kind"), ")"), "nth", 8), m, 13, OBSERVED, text_of("signs like numbers: ", F.col("items"))),
        _said(f.rows.select("doc_id").join(f.numerals.select("doc_id"), "doc_id", "left_anti"), m, 13, OBSERVED, F.lit("no signs like numbers")),
        _said(beside, m, 14, INFERRED, text_of(show(F.col("token")), " stands ", F.col("side"), " a number ", F.col("c"), " times, ", F.col("lift"), " x chance; such words name what is counted")),
        _said(_listed(f.names, _worded("word", "c"), "rk", 10), m, 15, INFERRED, text_of("words that may be names: ", F.col("items"))),
    ])


def comparison_claims(f: Findings) -> DataFrame:
    """What Method 4 claims of other languages."""
    m, parts = "comparison", [_said(co.anchors(f.scripts, f.numerals, f.names), "comparison", 7, INFERRED, text_of("a possible anchor: ", F.col("anchor")))]
    if f.closest is not None:
        near = _listed(f.closest, text_of(language_name(F.col("lang")), " (", F.col("distance"), ")"), "rk", 6)
        parts += [
            _said(near, m, 1, INFERRED, text_of("the profiles closest to its own: ", F.col("items"))),
            _said(near, m, 2, HYPOTHESIS, F.lit("a close profile is alike in numbers only; it is no kinship")),
        ]
    if f.lexical is not None:
        alike = co.look_alikes(f.lexical)
        best = f.lexical.filter("rk = 1").join(alike.select("doc_id"), "doc_id", "left_anti")
        rates = (percent(F.col("rate")), " of its words are within a letter of a word of ", language_name(F.col("lang")), ", of nonsense words ", percent(F.col("control")))
        parts += [
            _said(alike, m, 3, HYPOTHESIS, text_of(*rates, "; such as ", F.array_join(F.slice("examples", 1, 6), ", "))),
            _said(best, m, 4, INFERRED, text_of("no language shares vocabulary beyond chance; at best ", *rates)),
            _said(f.rows.select("doc_id").join(f.lexical.select("doc_id"), "doc_id", "left_anti"), m, 3, OBSERVED, F.lit("the values of the signs are unknown, so its words cannot be compared")),
        ]
    if f.deciphered is not None:
        d = f.deciphered
        judged = F.when(F.col("strong"), "worth a check by hand").otherwise("no more than chance")
        many = f.inventory.filter(F.col("distinct_signs") > co.MOST_SIGNS)
        several = d.filter("strong").groupBy("doc_id").agg(F.count("*").alias("n"), F.max_by("lang", "hit_rate").alias("lang")).filter("n > 1")
        parts += [
            _said(d, m, 5, HYPOTHESIS, text_of("with values from ", language_name(F.col("lang")), " ", percent(F.col("hit_rate")), " of its words are words of that language, in shuffles ", percent(F.col("control_rate")), ": ", judged, "; it begins ", F.substring("sample", 1, 120))),
            _said(many, m, 5, OBSERVED, text_of(F.col("distinct_signs"), " signs are too many for a search of letter values")),
            _said(several, m, 6, INFERRED, text_of("several languages do better than their controls, best ", language_name(F.col("lang")))),
        ]
    return _all(parts)


def claims(f: Findings) -> DataFrame:
    """doc_id, method, seq, label, text of all four methods."""
    return _all([inventory_claims(f), statistics_claims(f), structure_claims(f), comparison_claims(f)])
