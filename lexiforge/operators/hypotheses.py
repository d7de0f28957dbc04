"""The hypothesis language: commands, and their tests against each document.

A list of commands is a user's input and small by nature, so it travels as a literal array that each document's row
explodes: no exchange. The tests count in one pass over the tokens, keyed by (doc_id, hyp).
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiforge.functions.text import anchor_phrase, language_name, parse_label, show
from lexiforge.operators.batches import mapped as mapped_rows
from lexiforge.operators.signvalues import Trials, Values, figures
from lexiforge.operators.shuffle import shuffled_texts
from lexiforge.operators.staging import staged
from lexiforge.operators.statistics import joined
from lexiforge.operators.structure import with_numbers
from lexiforge.operators.wordforms import Words, control_key, control_pool, digits_of, paradigms, significant, strengths, text_of

def parse(lines: DataFrame) -> DataFrame:
    """H1: lines (hyp, line, other columns) with kind, token, meaning, anchor, role, affix, pairs (sign to value), language.

    Blank lines and lines that begin with # have no row. Anything else that is not a command has the kind ``unknown``.
    """
    line = F.regexp_replace(F.regexp_replace("line", r"(?U)\s+", " "), r"^ | $", "")
    d = lines.filter(F.col("line").rlike(r"(?U)\S") & ~F.startswith("line", F.lit("#"))).withColumn("_l", line)
    d = d.withColumn("_w", F.split("_l", " ")).withColumn("_rest", F.regexp_replace("_l", r"^\S+ ?", ""))
    first = F.lower(F.get("_w", F.lit(0)))
    kind = F.when(first == "gloss", "gloss").when((first == "role") & (F.size("_w") >= 3), "role").when(first == "affix", "affix").when(first == "values", "sign_values").otherwise("unknown")
    d = d.withColumn("kind", kind)

    def before(text: Column, mark: str) -> Column:
        return F.substring_index(text, mark, 1)

    def after(text: Column, mark: str) -> Column:
        return F.when(F.contains(text, F.lit(mark)), F.substring(text, F.instr(text, mark) + len(mark), F.char_length(text))).otherwise(F.lit(""))

    tail = after(F.col("_rest"), "=")
    gloss, affix, values = F.col("kind") == "gloss", F.col("kind") == "affix", F.col("kind") == "sign_values"
    pairs = F.filter(F.split(before(F.col("_rest"), " in "), " "), lambda p: F.contains(p, F.lit("=")))
    entries = F.transform(pairs, lambda p: F.struct(before(p, "=").alias("sign"), after(p, "=").alias("value")))
    language = F.trim(after(F.col("_rest"), " in "))
    return d.select(
        *lines.columns, "kind",
        F.when(gloss, F.trim(before(F.col("_rest"), "="))).when(F.col("kind") == "role", F.get("_w", F.lit(1))).alias("token"),
        F.when(gloss, F.trim(before(tail, " near "))).when(affix, F.trim(tail)).alias("meaning"),
        F.when(gloss, F.nullif(F.trim(after(tail, " near ")), F.lit(""))).alias("anchor"),
        F.when(F.col("kind") == "role", F.get("_w", F.lit(2))).alias("role"),
        F.when(affix, F.trim(before(F.col("_rest"), "="))).alias("affix"),
        F.when(values, entries).alias("pairs"),
        F.when(values, F.when(language == "", "en").otherwise(language)).alias("language"),
    )


def with_hypotheses(docs: DataFrame, lines: list[str], kind: str) -> DataFrame:
    """docs (doc_id, has_case) with the parsed commands of a kind, tokens in lower case where the document has both cases."""
    each = F.posexplode(F.array(*map(F.lit, lines))).alias("hyp", "line")
    h = parse(docs.select("doc_id", "has_case", each)).filter(F.col("kind") == kind)
    for c in ("token", "affix"):
        h = h.withColumn(c, parse_label(F.col(c), F.col("has_case")))
    return h.withColumn("target", parse_label(F.col("anchor"), F.col("has_case"))).withColumnRenamed("has_case", "has_case_")


def _mentioned(docs: DataFrame, lines: list[str], kind: str, column: str) -> list[str]:
    """What commands of a kind name in a column, as written and in lower case; a user's list, read to the driver."""
    spark = docs.sparkSession
    rows = parse(spark.createDataFrame(list(enumerate(lines)), "hyp int, line string")).filter(F.col("kind") == kind).select(column).distinct().collect() if lines else []
    return sorted({x for (w,) in rows if w for x in (w, w.lower())}) or [""]


def places(t: DataFrame) -> DataFrame:
    """H2, H3: each token with the tokens before and after it in its unit (p, q) and whether a number is next to it."""
    order = Window.partitionBy("doc_id", "unit_idx").orderBy("pos")
    cells = with_numbers(t).withColumn("p", F.lag("token").over(order)).withColumn("q", F.lead("token").over(order))
    near_num = F.coalesce(F.lag("is_num").over(order), F.lit(False)) | F.coalesce(F.lead("is_num").over(order), F.lit(False))
    return cells.select("doc_id", "unit_idx", F.col("token").alias("word"), "pos", "unit_len", "p", "q", near_num.alias("near_num"))


def _near() -> Column:
    """H3 of a place that was joined with a hypothesis."""
    beside = F.coalesce(F.col("p") == F.col("target"), F.lit(False)) | F.coalesce(F.col("q") == F.col("target"), F.lit(False))
    return F.when(F.col("anchor") == "numbers", F.col("near_num")).when(F.col("anchor") == "line_start", F.col("pos") == 0).when(F.col("anchor") == "line_end", F.col("pos") == F.col("unit_len") - 1).otherwise(beside)


@dataclass
class Doc:
    """A document as the tests see it: its name, whether it has both cases and word boundaries, its words and their counts in the order of the text."""

    name: str | None
    case: bool
    spaced: bool
    words: Words | None  # not needed for sign values
    counts: Counter[str]


#: Makes of some documents, for each, the uses of the commands of a kind: tuples that begin with the command's number.
Test = Callable[[list[Doc]], list[list[tuple]]]


def tested(docs: DataFrame, tests: dict[str, tuple[str, Test]]) -> DataFrame:
    """doc_id and, by name, the uses that tests (their schema, and what makes them) give, in one pass over each row of a corpus."""

    def of(names: list[str | None], texts: list[str], cased: list[bool | None], spaced: list[bool], digits: list[list[str]]) -> Iterator[tuple]:
        words = [Words.of(x, d) for x, d in zip(texts, digits, strict=True)]
        here = [Doc(n, bool(c), s, w, Counter(w.tokens)) for n, c, s, w in zip(names, cased, spaced, words, strict=True)]
        yield from zip(*(f(here) for _, f in tests.values()), strict=True)

    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("_name"), text_of(F.col("units")).alias("_text"), F.col("has_case").alias("_case"), (F.col("separator") != "none").alias("_spaced"))
    rows = rows.withColumn("_digits", digits_of(F.col("_text")))
    fields = {name: ", ".join(x.replace(" ", ": ", 1) for x in schema.split(", ")) for name, (schema, _) in tests.items()}
    return mapped_rows(rows, ["_name", "_text", "_case", "_spaced", "_digits"], ", ".join(f"{name} array<struct<{x}>>" for name, x in fields.items()), of)


def _uses(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("doc_id", F.explode(name).alias("x")).select("doc_id", "x.*")


def _commands(docs: DataFrame, lines: list[str], kind: str, *columns: str | Column) -> dict[bool, list[Row]]:
    """The commands of a kind, with their tokens as documents of one case and of both have them; a user's list, read to the driver."""
    cases = docs.sparkSession.createDataFrame([(0, False), (1, True)], "doc_id long, has_case boolean")
    rows = with_hypotheses(cases, lines, kind).select("has_case_", "hyp", *columns).orderBy("hyp").collect() if lines else []
    return {case: [r for r in rows if r["has_case_"] == case] for case in (False, True)}


_GLOSS = "hyp int, occurrences bigint, ok bigint, near bigint, cells bigint, anchored boolean"


def _beside(units: list[list[str]], mark: set[str], only: str | None = None) -> int:
    """Places, those of a word or all, with one of the marks before or after them in their unit."""
    n = 0
    for u in units:
        if not mark.isdisjoint(u) and (only is None or only in u):
            at = [w in mark for w in u]
            left, right = [False, *at[:-1]], [*at[1:], False]
            n += sum((x or y) and (only is None or w == only) for w, x, y in zip(u, left, right, strict=True))
    return n


def _gloss(docs: DataFrame, lines: list[str]) -> Test:
    commands = _commands(docs, lines, "gloss", "token", "anchor", "target")

    def of(here: list[Doc]) -> list[list[tuple]]:
        out = []
        for d in here:
            units, rows = d.words.units, []
            for r in commands[d.case]:
                token, anchor = r["token"], r["anchor"]
                n, ok, near = d.counts[token], 0, 0
                if n and anchor in ("line_start", "line_end"):
                    at = 0 if anchor == "line_start" else -1
                    ok, near = sum(u[at] == token for u in units), len(units)
                elif n and anchor is not None:
                    marks = d.words.numbers if anchor == "numbers" else {r["target"]} & d.counts.keys()
                    ok, near = (_beside(units, marks, token), _beside(units, marks)) if marks else (0, 0)
                rows.append((r["hyp"], n, ok, near, len(d.words.tokens), anchor is not None))
            out.append(rows)
        return out

    return of


def _glossed(x: DataFrame) -> DataFrame:
    testable = (F.col("occurrences") > 0) & F.col("anchored")
    x = x.withColumn("rate", F.when(testable, F.col("ok") / F.col("occurrences"))).withColumn("chance", F.when(testable, F.col("near") / F.col("cells")))
    verdict = F.when(F.col("rate").isNull(), "UNTESTABLE").when((F.col("rate") >= 0.7) & (F.col("rate") >= F.col("chance") * 2), "CONSISTENT").when(F.col("rate") <= F.greatest(F.col("chance") * 1.2, F.lit(0.2)), "INCONSISTENT").otherwise("PARTLY CONSISTENT")
    return x.select("doc_id", "hyp", "occurrences", F.round("rate", 3).alias("rate"), F.round("chance", 3).alias("chance"), verdict.alias("verdict"))


def gloss_test(docs: DataFrame, t: DataFrame, lines: list[str]) -> DataFrame:
    """H2-H5: doc_id, hyp, occurrences, rate, chance (the exact share over all places), verdict; ``docs`` is the corpus.

    A token that the document lacks, or a command without an anchor, is UNTESTABLE and has no rate.
    """
    return _glossed(_uses(tested(docs, {"gloss": (_GLOSS, _gloss(docs, lines))}), "gloss"))


def counterexamples(docs: DataFrame, c: DataFrame, t: DataFrame, lines: list[str], k: int = 3) -> DataFrame:
    """H5: doc_id, hyp, rk, unit: the first k units with a use of a glossed token that is not where the command says."""
    h = with_hypotheses(docs, lines, "gloss").filter("anchor IS NOT NULL").select("doc_id", "hyp", "token", "anchor", "target")
    cells = places(t).filter(F.col("word").isin(_mentioned(docs, lines, "gloss", "token"))).withColumnRenamed("word", "token")
    bad = h.join(cells, ["doc_id", "token"]).filter(~_near()).withColumn("rk", F.row_number().over(Window.partitionBy("doc_id", "hyp").orderBy("unit_idx", "pos"))).filter(F.col("rk") <= k)
    units = c.select("doc_id", F.posexplode("units").alias("unit_idx", "u"))
    return bad.join(units, ["doc_id", "unit_idx"]).select("doc_id", "hyp", "rk", F.array_join(F.transform("u", lambda w: show(w)), " ").alias("unit"))


_VALUES = "hyp int, n bigint, covered bigint, real double, s double, beaten int, seen int, known boolean"


def _values(docs: DataFrame, lines: list[str], lex: DataFrame, trials: int) -> Test:
    commands = _commands(docs, lines, "sign_values", "language", "pairs", F.transform("pairs", lambda p: parse_label(p["sign"], F.col("has_case_"))).alias("signs"))
    parsed = [r for rows in commands.values() for r in rows]
    letters = sorted(set("".join(p["value"] for r in parsed for p in r["pairs"])))
    named = sorted({r["language"] for r in parsed})
    words: dict[str, list[str]] = {r["lang"]: [] for r in lex.filter(F.col("lang").isin(named)).select("lang").distinct().collect()} if named else {}
    if words and letters:  # only words of the values' own signs can be met
        own = F.forall(F.filter(F.split("word", ""), lambda x: x != ""), lambda x: x.isin(letters))
        for r in lex.filter(F.col("lang").isin(named) & (F.char_length("word") >= 3) & own).select("lang", "word").distinct().toLocalIterator():
            words[r["lang"]].append(r["word"])
    ready = {case: [(r["hyp"], r["language"] in words, Values(r["signs"], [p["value"] for p in r["pairs"]], words.get(r["language"], []), trials)) for r in rows] for case, rows in commands.items()}

    def of(here: list[Doc]) -> list[list[tuple]]:
        found: list[list[tuple]] = [[] for _ in here]
        for case, each in ready.items():
            for hyp, known, values in each:
                rows = [(i, values.covered(d.counts)) for i, d in enumerate(here) if d.case == case]
                testable = [(i, w) for i, w in rows if w and known]
                orders = Trials(len(values.values), trials).orders([here[i].name or "" for i, _ in testable])
                got = {i: figures(values.rates(w, o)) for (i, w), o in zip(testable, orders, strict=True)}
                for i, w in rows:
                    found[i].append((hyp, here[i].counts.total(), sum(c for _, c in w) if w else None, *got.get(i, (None, None, 0, 0)), known))
        return [sorted(x) for x in found]

    return of


def _valued(x: DataFrame, trials: int) -> DataFrame:
    ok = F.col("covered").isNotNull() & F.col("known")
    rate = F.coalesce("real", F.lit(0.0))
    # a trial without any word of three signs has the rate 0
    beaten = F.col("beaten") + F.when(rate <= 0, F.lit(trials) - F.col("seen")).otherwise(0)
    p = (1 + beaten) / (trials + 1.0)
    verdict = F.when(~ok, "UNTESTABLE").when((p < 0.01) & (rate > 0.1), "CONSISTENT").when(p < 0.05, "PARTLY CONSISTENT").otherwise("INCONSISTENT")
    return x.select("doc_id", "hyp", F.round(F.when(ok, F.col("covered") / F.col("n")), 4).alias("coverage"), F.round(F.when(ok, rate), 4).alias("rate"), F.round(F.when(ok, F.coalesce("s", F.lit(0.0)) / trials), 8).alias("null_mean"), F.round(F.when(ok, p), 4).alias("p_value"), verdict.alias("verdict"))


def values_test(docs: DataFrame, t: DataFrame, lines: list[str], lex: DataFrame, trials: int = 200) -> DataFrame:
    """doc_id, hyp, coverage, rate, null_mean, p_value, verdict of sign values against shuffles of the same values; ``docs`` is the corpus.

    Trial i orders the values by md5 of trial, document and place; trial 0 is the mapping itself. Distinct tokens are decoded,
    not places, and a row of the corpus gives all of it. The words of the languages that commands name travel with the
    function. Documents without a word that the mapping covers, or languages without a lexicon, are UNTESTABLE.
    """
    values = _values(docs, lines, lex, trials)

    def of(texts: list[str], cased: list[bool | None], names: list[str | None]) -> Iterator[tuple]:
        yield from ((x,) for x in values([Doc(n, bool(c), False, None, Counter(x.split("\n") if x else ())) for x, c, n in zip(texts, cased, names, strict=True)]))

    rows = docs.select("doc_id", joined(F.flatten("units")).alias("_text"), F.col("has_case").alias("_case"), F.col("doc_id").cast("string").alias("_name"))
    fields = ", ".join(x.replace(" ", ": ", 1) for x in _VALUES.split(", "))
    x = _uses(mapped_rows(rows, ["_text", "_case", "_name"], f"uses array<struct<{fields}>>", of), "uses")
    return _valued(x, trials)


def verdicts(docs: DataFrame, c: DataFrame, t: DataFrame, lines: list[str], lex: DataFrame, trials: int = 200) -> DataFrame:
    """doc_id, hyp, kind, description, verdict, evidence of all commands; what is no command is UNTESTABLE."""
    spark = docs.sparkSession
    every = parse(spark.createDataFrame(list(enumerate(lines)), "hyp int, line string")).withColumn("signs", F.size("pairs"))
    rows = staged(tested(docs, {"gloss": (_GLOSS, _gloss(docs, lines)), "role": (_ROLE, _role(docs, lines)), "affix": (_AFFIX, _affix(docs, lines)), "sign_values": (_VALUES, _values(docs, lines, lex, trials))}))
    pct = lambda x: F.concat(F.round(F.col(x) * 100).cast("int").cast("string"), F.lit(" %"))
    gloss = _glossed(_uses(rows, "gloss")).select("doc_id", "hyp", "verdict", F.when(F.col("rate").isNotNull(), F.concat(F.lit("in place in "), pct("rate"), F.lit(" of "), F.col("occurrences").cast("string"), F.lit(" uses; a random place would be in "), pct("chance"))).otherwise(F.lit("the token does not occur, or no anchor is given")).alias("evidence"))
    role = _judged(_uses(rows, "role")).select("doc_id", "hyp", "verdict", F.concat_ws(" ", F.coalesce(F.col("passed").cast("string"), F.lit("no")), F.lit("of"), F.coalesce(F.col("checks").cast("string"), F.lit("no")), F.lit("checks hold over"), F.col("occurrences").cast("string"), F.lit("uses")).alias("evidence"))
    affix = _affixed(_uses(rows, "affix")).select("doc_id", "hyp", "verdict", F.concat_ws(" ", F.lit("on"), F.col("types").cast("string"), F.lit("word types;"), F.col("other_stems").cast("string"), F.lit("of their stems have other forms")).alias("evidence"))
    values = _valued(_uses(rows, "sign_values"), trials).select("doc_id", "hyp", "verdict", F.when(F.col("rate").isNotNull(), F.concat(F.lit("covers "), pct("coverage"), F.lit(" of words; "), pct("rate"), F.lit(" become words, after shuffles "), pct("null_mean"), F.lit(", p = "), F.col("p_value").cast("string"))).otherwise(F.lit("no word is covered, or there is no lexicon")).alias("evidence"))
    unknown = [r["hyp"] for r in every.filter("kind = 'unknown'").select("hyp").collect()]
    other = rows.select("doc_id", F.explode(F.array(*map(F.lit, unknown)).cast("array<int>")).alias("hyp")).select("doc_id", "hyp", F.lit("UNTESTABLE").alias("verdict"), F.lit("not a command").alias("evidence"))
    found = gloss.unionByName(role).unionByName(affix).unionByName(values).unionByName(other)
    description = (
        F.when(F.col("kind") == "gloss", F.concat_ws(" ", "token", F.lit("means"), "meaning", F.when(F.col("anchor").isNotNull(), anchor_phrase(F.col("anchor"))))).when(F.col("kind") == "role", F.concat_ws(" ", "token", F.lit("is a"), "role"))
        .when(F.col("kind") == "affix", F.concat_ws(" ", "affix", F.lit("means"), "meaning")).when(F.col("kind") == "sign_values", F.concat_ws(" ", F.lit("values of"), F.col("signs").cast("string"), F.lit("signs in"), language_name(F.col("language")))).otherwise(F.lit("unknown"))
    )
    every = F.broadcast(every.select("hyp", "kind", description.alias("description")))  # a row for each command
    return found.join(every, "hyp").select("doc_id", "hyp", "kind", "description", "verdict", "evidence")


_ROLE = "hyp int, occurrences bigint, passed int, checks int"


def _inflected(docs: list[tuple[Doc, list[str]]]) -> list[set[str]]:
    """Which of some words of each document belong to a suffix paradigm, its affixes being significant.

    The word forms are only judged where one of the words has another form beside it and stands in a paradigm.
    """
    out: list[set[str]] = [set() for _ in docs]
    maybe: list[tuple[int, set[str], set[str]]] = []
    for i, (d, words) in enumerate(docs):
        types = set(d.words.words)
        if not d.spaced or len(types) < 20:
            continue
        stems = {w[: len(w) - k] for w in words for k in range(4) if len(w) - k >= 2}
        # a paradigm's words begin with its stem, and go on for three signs at most
        forms = Counter(w[: len(w) - k] for w in types for k in range(4) if w[: len(w) - k] in stems)
        some = [w for w in words if w in types and any(forms[w[: len(w) - k]] >= 2 for k in range(4) if len(w) - k >= 2)]
        if some and (mine := {stem + e for stem, ends in paradigms(types).items() for e in ends}.intersection(some)):
            maybe.append((i, types, mine))
    keys = [control_key(docs[i][0].name) for i, _, _ in maybe]
    texts = shuffled_texts([(key, "\n".join(docs[i][0].words.words)) for key, (i, _, _) in zip(keys, maybe, strict=True)])
    for key, (i, types, mine), mixed in zip(keys, maybe, texts, strict=True):
        if significant(strengths(types, control_pool(key, mixed, len(types)))):
            out[i] = mine
    return out


def _role(docs: DataFrame, lines: list[str]) -> Test:
    commands = _commands(docs, lines, "role", "token", "role")

    def of(here: list[Doc]) -> list[list[tuple]]:
        asked = [[r["token"] for r in commands[d.case] if r["role"] in ("function_word", "name") and d.counts[r["token"]]] for d in here]
        inflected = _inflected(list(zip(here, asked, strict=True)))
        out = []
        for d, forms in zip(here, inflected, strict=True):
            units, rows = d.words.units, []
            for r in commands[d.case]:
                w, passed = r["token"], None
                if c := d.counts[w]:
                    at = [i for i, u in enumerate(units) if w in u]
                    still = w not in forms
                    passed = {
                        "function_word": lambda: [c / len(d.words.tokens) > 0.005, len({i * 10 // len(units) for i in at}) >= 7, still], "number": lambda: [w in d.words.numbers],  # noqa: B023
                        "name": lambda: [2 <= c <= 10, still, (at[-1] - at[0]) * 10 <= len(units) * 3],  # noqa: B023
                        "unit_start": lambda: [sum(units[i][0] == w for i in at) * 10 >= c * 6], "unit_end": lambda: [sum(units[i][-1] == w for i in at) * 10 >= c * 6],  # noqa: B023
                    }.get(r["role"], lambda: None)()
                rows.append((r["hyp"], c, None if passed is None else sum(passed), None if passed is None else len(passed)))
            out.append(rows)
        return out

    return of


def _judged(x: DataFrame) -> DataFrame:
    return x.withColumn("verdict", F.when(F.col("checks").isNull(), "UNTESTABLE").when(F.col("passed") == F.col("checks"), "CONSISTENT").when(F.col("passed") == 0, "INCONSISTENT").otherwise("PARTLY CONSISTENT"))


def role_test(docs: DataFrame, t: DataFrame, lines: list[str]) -> DataFrame:
    """doc_id, hyp, occurrences, passed, checks, verdict; ``docs`` is the corpus."""
    return _judged(_uses(tested(docs, {"role": (_ROLE, _role(docs, lines))}), "role"))


_AFFIX = "hyp int, occurrences bigint, types bigint, other_stems bigint, bare_stems bigint"


def _affix_uses(counts: Counter, ordered: list[str], a: str) -> tuple[int, int, int, int]:
    """H11 of an ending: uses, word types, those whose stem begins another type too, those whose stem is a word. ordered: the types in order."""
    carry = [w for w in ordered if len(w) > len(a) + 1 and w.endswith(a)] if a else []
    stems = [w[: len(w) - len(a)] for w in carry]
    # types that begin with a stem stand together, from the place of the stem on
    places = [bisect_left(ordered, stem) + 1 for stem in stems]
    others = sum(at < len(ordered) and ordered[at].startswith(stem) for at, stem in zip(places, stems, strict=True))
    return sum(counts[w] for w in carry), len(carry), others, sum(stem in counts for stem in stems)


def _affix(docs: DataFrame, lines: list[str]) -> Test:
    commands = {case: [(r["hyp"], not (r["affix"] or "").startswith("-"), (r["affix"] or "").strip("-")) for r in rows] for case, rows in _commands(docs, lines, "affix", "affix").items()}

    def of(here: list[Doc]) -> list[list[tuple]]:
        out = []
        for d in here:
            words = {False: (d.counts, sorted(d.counts))}
            if any(back for _, back, _ in commands[d.case]):
                back_counts = Counter({w[::-1]: n for w, n in d.counts.items()})
                words[True] = back_counts, sorted(back_counts)
            out.append([(hyp, *_affix_uses(*words[back], a[::-1] if back else a)) for hyp, back, a in commands[d.case]])
        return out

    return of


def _affixed(x: DataFrame) -> DataFrame:
    return x.withColumn("verdict", F.when(F.col("other_stems") >= 3, "CONSISTENT").when(F.col("other_stems") > 0, "PARTLY CONSISTENT").otherwise("INCONSISTENT"))


def affix_test(docs: DataFrame, t: DataFrame, lines: list[str]) -> DataFrame:
    """doc_id, hyp, occurrences, types, other_stems, bare_stems, verdict; ``docs`` is the corpus.

    A stem has another form if two word types begin (for a beginning: end) with it. Types and stems lie in one document, so a
    row of the corpus gives all of it. An empty affix carries no stem and is INCONSISTENT.
    """
    return _affixed(_uses(tested(docs, {"affix": (_AFFIX, _affix(docs, lines))}), "affix"))
