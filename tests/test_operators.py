import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.functions import text as ft
from lexiforge.operators import corpus as oc
from lexiforge.operators import detection as dt
from lexiforge.operators import findings as fi
from lexiforge.operators import language as lg
from lexiforge.operators import statistics as st
from lexiforge.operators import structure as ms
from lexiforge.operators import summary as su
from lexiforge.operators.staging import staged
from lexiforge.plans import registry

SF = "/root/testdata/sf0.001"


def made(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_units_tokens_and_case(spark):
    c = oc.corpus(made(spark, "One two, three. Four! Five?\nSix", "ab cd\nef gh", "", None)).orderBy("doc_id").collect()
    assert c[0]["units"] == [["one", "two", "three"], ["four"], ["five"], ["six"]] and c[0]["unit_kind"] == "sentence" and c[0]["has_case"]
    assert c[1]["units"] == [["ab", "cd"], ["ef", "gh"]] and c[1]["unit_kind"] == "line"
    assert c[2]["units"] == [] and c[3]["units"] == []


def test_windows_of_twelve(spark):
    (c,) = oc.corpus(made(spark, " ".join(f"w{i}" for i in range(65)))).collect()
    assert c["unit_kind"] == "12-token window" and [len(u) for u in c["units"]] == [12] * 5 + [5]


def test_sign_divider_and_none(spark):
    divided = "xabcxbcaxcabxacbxbacxcbaxaabxbbcxccaxabbxbccxcaax" * 3
    got = {r["doc_id"]: r for r in oc.corpus(made(spark, divided, "abcabcabc")).collect()}
    assert got[1]["separator"] == "none" and got[1]["units"][0] == list("abcabcabc")
    assert got[0]["separator"] in ("sign x", "none")


def test_entropies_by_hand(spark):
    t = oc.tokens(oc.corpus(made(spark, "ab ab ba\n ab")))
    (s,) = st.sign_inventory(t).collect()
    assert s["total_signs"] == 8 and s["distinct_signs"] == 2 and s["h1"] == 1.0
    (h,) = st.conditional_entropy(t).collect()
    # pairs: ^a 3, ^b 1, ab 3, ba 1, b$ 3, a$ 1 of 12
    want = -sum(c / 12 * math.log2(c / n) for c, n in ((3, 4), (1, 4), (3, 4), (1, 4), (3, 4), (1, 4)))
    assert abs(h["h_cond"] - want) < 1e-9


def test_shuffled_keeps_signs_and_lengths(spark):
    t = oc.tokens(oc.corpus(made(spark, "abc de fghi\njk lmn")))
    out = st.shuffled(t, [0, 1]).orderBy("seed", "tok_idx").collect()
    for seed in (0, 1):
        words = [r["token"] for r in out if r["seed"] == seed]
        assert [len(w) for w in words] == [3, 2, 4, 2, 3] and sorted("".join(words)) == sorted("abcdefghijklmn")


def test_verdict_averages_five_shuffles(spark):
    t = oc.tokens(oc.corpus(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(5))).cache()
    types = {}
    for r in st.shuffled(t, [0, 1, 2, 3, 4]).groupBy("doc_id", "seed").agg(F.count_distinct("token").alias("n")).collect():
        types.setdefault(r["doc_id"], []).append(r["n"])
    ids = list(types)
    got = registry.QUERIES["structure_verdict"](spark, SF).filter(F.col("doc_id").isin(ids)).collect()
    assert len(got) == len(ids) and all(abs(r["types_shuffled"] - sum(types[r["doc_id"]]) / 5) < 0.006 and len(types[r["doc_id"]]) == 5 for r in got)


def test_names_are_uninflected_and_signatures_beat_the_control(spark):
    stems = ["kalor", "mitan", "posek", "rudil", "tevan", "galut", "hinor", "safel", "borik", "dumas"]
    words = [s + e for s in stems for e in ("", "um", "is", "ax")]
    fill = ["zq", "xw", "jy", "vq", "wk", "qh"]
    text = " ".join(words[:20] + words[:20] + ["oprthewd", "oprthewd"] + words[20:] + fill * 40)
    docs = spark.createDataFrame([(1, text), (2, " ".join(fill * 9))], "doc_id long, text string")
    c = oc.corpus(docs)
    t = oc.tokens(c).cache()
    names = {r["token"] for r in fi.uninflected_names(t, c).collect() if r["doc_id"] == 1}
    assert "oprthewd" in names and not names & set(words) and {r["token"] for r in ms.caseless_names(t).collect()} & set(words)
    real = {(r["doc_id"], r["endings"]): r["stems"] for r in fi.controlled_signatures(t, c).collect()}
    best = max([r["stems"] for r in ms.signatures(fi.control(t, c)[2]).collect()] + [2])
    assert real == {(r["doc_id"], r["endings"]): r["stems"] for r in ms.signatures(fi.words_only(t)).collect() if r["doc_id"] == 1 and r["stems"] >= 2 * best} and real


def test_numerals_and_labels(spark):
    t = oc.tokens(oc.corpus(made(spark, "\n".join(["foo ||| bar"] * 2 + ["baz tor bar qux"] * 9 + ["7 zap"]))))
    kinds = {(r["sign"], r["kind"]) for r in ms.numeral_signs(t).collect()}
    assert ("|", "tally") in kinds and ("7", "digit") in kinds
    got = spark.createDataFrame([(chr(0xE005),), (chr(0xF0000 + 1234),), ("x",)], "s string").select(ft.label(F.col("s"))).collect()
    assert [r[0] for r in got] == ["P005", "G1234", "x"]


def test_redaction_counts_substitutions(spark):
    docs = made(spark, "api_key = sk-ant-abcdefghijkl", "password: 'hunter22'", "nothing")
    got = {r["doc_id"]: (r["text"], r["hits"]) for r in ft.redact(docs).collect()}
    assert got[0] == ("api_key = <redacted>", 2) and got[1] == ("password: <redacted>", 1) and got[2] == ("nothing", 0)


@pytest.mark.parametrize("name", ["word_statistics", "conditional_entropy", "affix_signatures", "positional_words", "redact_documents", "script_profile", "tier_routing", "keywords", "extractive_summary", "function_words", "gloss_test", "affix_test"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(registry.ORACLE_SQL[name])
    cols = [d[0] for d in want.description]
    got = registry.QUERIES[name](spark, SF).select(*cols).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def by_sql(expression):
    return duckdb.execute(f"SELECT {expression}").fetchone()[0]


def test_positional_rounds_next_to_halves_as_the_sql(spark):
    # 3 of 5 uses come first, and 4 of 51 places are first: 7.65 in decimals, 7.6499999999999995 as a double
    rows = [(1, i, "w", 0 if i < 3 else 1, 3) for i in range(5)] + [(1, 5 + i, f"v{i}", 0 if i < 1 else 1, 3) for i in range(46)]
    t = spark.createDataFrame(rows, "doc_id long, tok_idx int, token string, pos int, unit_len int")
    assert [r["ratio"] for r in ms.positional(t).filter("side = 'first'").collect()] == [by_sql("round(3::BIGINT / 5 / (4::BIGINT / 51), 1)")] == [7.7]


def test_profile_rounds_next_to_halves_as_the_sql(spark):
    from lexiforge.operators import compare as co

    t = spark.createDataFrame([(1, i, "abc" if i < 7 else "ab") for i in range(640)], "doc_id long, tok_idx int, token string")
    (p,) = co.doc_profile(t, spark.createDataFrame([], "doc_id long, suffix long, prefix long")).collect()
    assert p["word_len"] == by_sql("round(1287 / 640, 6)") == 2.010937


def test_summary_rounds_next_to_halves_as_the_sql(spark):
    from lexiforge.operators import summary as su

    # a sentence of 64 words, one 24 times, 15 twice, 10 once
    names = [a + b for a in "abcde" for b in "vwxyz"]
    docs = spark.createDataFrame([(1, " ".join(["qq"] * 24 + names[:15] * 2 + names[15:]), "en")], "doc_id long, text string, lang string")
    (s,) = su.extractive_summary(docs, spark.createDataFrame([], "lang string, word string, zipf double")).collect()
    assert s["score"] == by_sql("round(CAST(646 * 7.5 AS DOUBLE) / CAST(24 * 7.5 AS DOUBLE) / sqrt(64) * CAST(1.2 AS DOUBLE), 3)") == 4.037


def test_summary_without_weights_scores_as_the_sql(spark, tmp_path):
    # every word of the language en is so frequent that it weighs nothing: 0 over 0 is NaN; in xx the second row has rare words
    rows = [(1, "The of the of the. " * 7, "en"), (2, "The house of the river.", "xx"), (3, "The of the of the. " * 40, "xx"), (4, "The of the of the.", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL["extractive_summary"]).fetchall()
    got = registry.QUERIES["extractive_summary"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert [r["doc_id"] for r in got if r["score"] != r["score"]].count(1) == 5


def test_order_of_the_shuffle_is_that_of_md5(spark):
    import hashlib

    from lexiforge.operators.shuffle import orders, shuffled_texts

    for key, n in (("0:12", 9000), ("3:" + "x" * 60, 30), ("0:9", 1), ("1:\u00e9", 1234), ("0:5", 0)):
        assert list(next(orders([(key, n)]))) == sorted(range(n), key=lambda i: hashlib.md5(f"{key}:{i}".encode()).hexdigest())
    place = sorted(range(6), key=lambda i: hashlib.md5(f"7:1:{i}".encode()).hexdigest())
    assert next(shuffled_texts([("7:1", "ab\ncde\nf")])).replace("\n", "") == "".join("abcdef"[i] for i in place)


@pytest.mark.parametrize("name", ["structure_verdict", "zipf_curve"])
def test_shuffles_exchange_nothing(spark, name):
    assert "Exchange" not in registry.QUERIES[name](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString().replace("Exchange hashpartitioning(doc_id", "", 1)


def test_word_forms_in_one_pass_are_those_of_the_tables(spark):
    from lexiforge.operators.wordforms import found

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40)
    odd = spark.createDataFrame([(1 << 60, "||| 77 foo ||| bar ||| ||| foo. " * 9), (-1, None), (-2, "a b c d e f g h i j k l m n o p q r s t u v \U0001d7d8 \U00010400x"), (-3, "abcabcabc" * 30)], "doc_id long, text string")
    c = oc.corpus(docs.unionByName(odd)).cache()
    t = oc.tokens(c).cache()
    rows = {r["doc_id"]: r for r in found(c).collect()}
    assert len(rows) == 44 and rows[-1]["types"] is None and rows[-3]["types"] is None
    types, w, pool = fi.control(t, c)
    assert {r["doc_id"]: r["types"] for r in types.collect()} == {k: r["types"] for k, r in rows.items() if r["types"] is not None}
    for source, name, reverse in ((w, "suffix", False), (w, "prefix", True), (pool, "control_suffix", False), (pool, "control_prefix", True)):
        scores = {r["doc_id"]: r["s"] for r in ms.affix_scores(source, reverse, 10).groupBy("doc_id").agg(F.sum("score").alias("s")).collect()}
        assert {k: scores.get(k, 0) for k, r in rows.items() if r["types"] is not None} == {k: r[name] for k, r in rows.items() if r["types"] is not None}
    real = [r["doc_id"] for r in fi.affix_control(found(c)).filter("significant").collect()]
    words = {(r["doc_id"], r["token"]) for r in ms.paradigm_words(fi.words_only(t).filter(F.col("doc_id").isin(real))).collect()}
    assert words == {(k, x) for k, r in rows.items() for x in r["inflected"]} and words


@pytest.mark.parametrize("name", ["affix_control", "function_words", "word_order_hint", "name_candidates_uninflected", "affix_signatures_controlled"])
def test_word_forms_exchange_nothing(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "SortMergeJoin" not in plan  # one at most: a table of few splits is dealt over the cores


def test_affix_test_exchanges_nothing_and_counts_by_hand(spark):
    from lexiforge.operators import hypotheses as hy

    c = oc.corpus(made(spark, "walking walked walk Singing sing. ring undo undone. redo", "", None))
    out = hy.affix_test(c, c, ["affix -ing = GERUND", "affix un- = NOT", "affix - = NOTHING", "role x name"])
    got = {(r["doc_id"], r["hyp"]): tuple(r)[2:] for r in out.collect()}
    # walking: walk, walked, singing: sing; s(ing) and r(ing) have stems of one sign; undo and undone: redo ends with do, nothing else with done
    assert got[0, 0] == (2, 2, 2, 2, "PARTLY CONSISTENT") and got[0, 1] == (2, 2, 1, 0, "PARTLY CONSISTENT") and got[0, 2] == (0, 0, 0, 0, "INCONSISTENT")
    assert len(got) == 9 and got[2, 0] == (0, 0, 0, 0, "INCONSISTENT")
    assert registry.QUERIES["affix_test"](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1


def test_trials_and_decoded_words_agree_with_plain_ones():
    import hashlib

    import numpy as np

    from lexiforge.operators.signvalues import Trials, Values, figures

    docs = ["7", "123456", "x" * 60]  # the last is too long for one block
    for n in (3, 12):
        for doc, got in zip(docs, Trials(n, 120).orders(docs), strict=True):
            want = [sorted(range(n), key=lambda i: hashlib.md5(f"{t}:{doc}:{i}".encode()).hexdigest() if t else f"{i:09d}") for t in range(121)]  # noqa: B023
            assert got.tolist() == want
    words = [("abc", 3), ("cab", 1), ("ab", 5), ("c" * 45, 2)]
    for values in (["x", "y", "z"], ["x", "yy", ""], ["x", "x", "z"]):
        lexicon = ["xyz", "zxy", "xxx", "xyyx", "yyx", "z" * 45, "xyq"]
        v, orders = Values(["a", "b", "c"], values, lexicon, 50), Trials(3, 50).orders(["9"])[0]
        read = [[("".join(values[o["abc".index(x)]] for x in w), c) for w, c in words] for o in orders]
        read = [[(w, c) for w, c in r if len(w) >= 3] for r in read]
        want = [sum(c for w, c in r if w in lexicon) / sum(c for _, c in r) if r else np.nan for r in read]
        assert np.allclose(v.rates(words, orders), want, atol=0, equal_nan=True)
        assert figures(v.rates(words, orders))[3] == sum(not np.isnan(x) for x in want[1:])


def test_marks_go_from_whole_chunks(spark):
    c = oc.corpus(made(spark, "O'Neil’s (co-op) … ΟΔΟΣ. ab cd -- x.y")).first()
    assert c["units"] == [["oneils", "coop", "οδος"], ["ab", "cd", "xy"]] or [w for u in c["units"] for w in u] == ["oneils", "coop", "οδος", "ab", "cd", "xy"]


def test_masks_of_near_words_agree_with_deletions():
    import random

    import pyarrow as pa

    from lexiforge.operators.nearwords import Index

    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcé~") for _ in range(n))
    cuts = lambda w: [w] + [w[:i] + w[i + 1 :] for i in range(len(w))]
    table = {(lang, v): w for lang in ("en", "xx") for w in (word(r.randint(3, 6)) for _ in range(60)) for v in cuts(w)}
    index = Index.of("test", pa.table({"lang": [k[0] for k in table], "variant": [k[1] for k in table], "word": list(table.values())}))
    real, nonsense = [{word(r.randint(3, 7)) for _ in range(80)} for _ in range(3)] + [set()], [{word(4) for _ in range(30)}, set(), {"zzz"}, set()]
    match = lambda w, lang: next((table[lang, v] for v in cuts(w) if (lang, v) in table), None)
    for words, other, (hits, control, examples) in zip(real, nonsense, index.counted(real, nonsense, str.lower), strict=True):
        for i, lang in enumerate(index.langs):
            found = sorted(f"{w}~{match(w, lang)}" for w in words if match(w, lang) is not None)
            assert hits[i] == len(found) and examples[i] == found[:10] and control[i] == sum(match(w, lang) is not None for w in other)


def test_travelling_and_joined_indexes_agree(spark):
    from lexiforge.operators import compare as co
    from lexiforge.operators.staging import staged

    lex = spark.createDataFrame([("en", i + 1, w) for i, w in enumerate(["house", "straße", "tree", "mouse"])] + [("xx", 1, "hous")], "lang string, rank int, word string")
    c = oc.corpus(made(spark, "Der Strasse hause trees. Houses moues tre!", "ab c", ""))
    index = staged(co.deletion_index(lex))
    a, b = ([tuple(r) for r in co.lexical_matching(c, ["en", "xx", "yy"], index, most=m).orderBy("doc_id", "rk").collect()] for m in (10**6, 1))
    assert a == b and len(a) == 3


def test_equal_glyphs_are_clustered_once():
    import numpy as np

    from lexiforge.operators import images as im

    x = np.random.default_rng(1).normal(size=(12, 8)).astype(np.float32) / 4
    of = np.random.default_rng(2).integers(0, 12, 300)
    alone, together = im.average_linkage(x[of], 0.9), im.labelled(x[of], 0.9)
    assert im.by_frequency(alone).tolist() == im.by_frequency(together).tolist()


def test_wide_pages_are_blurred_in_strips():
    import numpy as np

    from lexiforge.operators import images as im

    grey = np.random.default_rng(4).integers(0, 256, (9, 2 * im.STRIP + 1)).astype(np.uint8)
    g = np.rint(im.blurred(grey.astype(float))).astype(int)
    ink = im.ink_of(grey)
    assert any((ink == (g <= k)).all() or (ink == (g > k)).all() for k in range(256))


DETECTED = [(1, "xx xx yy", "a"), (2, "Xx pqr pqr", "b"), (3, None, "b"), (4, "12 \ue000", None), (5, "xx", "a")]


def test_detection_in_one_pass_agrees_with_the_joins(spark):
    d = spark.createDataFrame(DETECTED, "doc_id long, text string, lang string")
    freq = staged(lg.frequencies(d))
    model = staged(lg.frequency_model(freq))
    assert {r["gram"]: r["gain"] for r in model.filter("lang = 'a'").collect()} == pytest.approx({" xx": math.log(7), "xx ": math.log(7), " yy": math.log(3), "yy ": math.log(3)})
    docs = d.select("doc_id", "text")
    joined = {r["doc_id"]: r.asDict() for r in lg._joined(docs, model, freq).collect()}
    for r in lg._within(docs, dt.reference(model, freq), freq).collect():
        assert r.asDict() == joined[r["doc_id"]]


def test_rare_words_are_counted_in_the_join(spark, monkeypatch):
    d = spark.createDataFrame(DETECTED, "doc_id long, text string, lang string")
    freq = staged(lg.frequencies(d))
    monkeypatch.setattr(dt, "TRAVELS", 8.6)  # zipf of xx in a is 8.88, of yy 8.40
    travels = dt.reference(staged(lg.frequency_model(freq)), freq)
    assert "xx" in travels.words and "yy" not in travels.words
    got = {r["doc_id"]: r["coverage"] for r in lg._within(d.select("doc_id", "text"), travels, freq).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: None, 4: None, 5: 1.0}


def test_a_long_memory_is_not_walked_for_each_document():
    r = dt.Reference("memory", ["a"], np.zeros(0, np.int64), np.zeros((1, 1)), np.zeros(1), ["xx"], np.full((1, 1), 9.0))
    m = dt.Words(r)
    m.add(["yyy", "z"])
    assert m.grams[:3].tolist() == [2, 3, 1] and m.at == {"xx": 0, "yyy": 1, "z": 2}


def test_scripts_exchange_nothing_and_count_by_hand(spark):
    d = spark.createDataFrame([(1, "aé א\U0001F600͸"), (2, None)], "doc_id long, text string")
    out = lg.script_profile(d)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, 5, "LATIN", 0.4, "left-to-right"), (2, 0, None, 0.0, None)]


def test_summary_and_keywords_in_two_passes_agree_with_the_tables(spark, monkeypatch):
    monkeypatch.setattr(dt, "TRAVELS", 6.0)  # some words travel, others are joined
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").filter("doc_id % 3 = 0 AND lang IS NOT NULL")
    freq = staged(lg.frequencies(d.filter("doc_id % 2 = 0")))  # of the other documents some words are unknown
    assert 0 < freq.filter(f"zipf > {dt.TRAVELS}").count() < freq.count()
    got = {r["doc_id"]: (r["summary"], r["keywords"]) for r in su.both(d, freq).collect()}
    want = {r["doc_id"]: ([], []) for r in d.collect()}
    for r in su.extractive_summary(d, freq).orderBy("doc_id", "sentence_idx").collect():
        want[r["doc_id"]][0].append(r["sentence"])
    for r in su.keywords(d, freq).orderBy("doc_id", "rk").collect():
        want[r["doc_id"]][1].append(r["word"])
    assert got == want


def test_each_redaction_has_its_hint(spark):
    rows = ["sk-ant-" + "a" * 12, "sk-" + "b" * 24, "AKIA" + "C" * 16, *[f"gh{x}_" + "d" * 30 for x in "pousr"], "AIza" + "e" * 32, "xoxb-" + "f" * 12, "-----BEGIN PRIVATE KEY-----\nx\n-----END PRIVATE KEY-----", *[f"{x.upper()}=hunter22" for x in ("api_key", "apikey", "secret", "password", "passwd", "token", "auth")], "night: keyboard"]
    assert [r["hits"] for r in ft.redact(made(spark, *rows)).orderBy("doc_id").collect()] == [2, 2] + [1] * (len(rows) - 3) + [0]  # API_KEY=<redacted> counts again


def test_look_alikes_keep_all_languages_and_words(spark, tmp_path):
    import random

    r = random.Random(5)
    word = lambda n=7: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    shared = sorted({word() for _ in range(60)} | {word(3) for _ in range(40)})  # of short words nonsense has some too
    filler = sorted({word(9) for _ in range(30050)})
    rows = [(i, " ".join(shared), lang) for i, lang in enumerate(["aa", "bb", "cc", "dd", "ee"])]
    rows += [(5, " ".join(filler + filler), "ff"), (6, " ".join(shared), "ff")]  # words beyond the 30000th of ff
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["look_alikes"](spark, str(tmp_path)).filter("doc_id = 0").collect()
    assert sorted(x["lang"] for x in got) == ["aa", "bb", "cc", "dd", "ee", "ff"]
    assert sorted(x["rk"] for x in got) == [1, 2, 3, 4, 5, 6]


def test_look_alikes_equal_sql_by_travelling_and_by_joins(spark, monkeypatch):
    from lexiforge.operators import compare as co

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(registry.ORACLE_SQL["look_alikes"])
    cols, want = [d[0] for d in want.description], sorted(map(str, want.fetchall()))
    travels = co.travels
    for most in (10**7, 0):
        monkeypatch.setattr(co, "travels", lambda index, _, most=most: travels(index, most))
        assert sorted(map(str, map(tuple, registry.QUERIES["look_alikes"](spark, SF).select(*cols).collect()))) == want
    assert len(want) > 0


def test_searches_together_go_as_alone_and_patterns_once(monkeypatch):
    from lexiforge.operators import compare as co
    from lexiforge.operators import searches

    letters = ["#", *"etaonis"]
    logp = searches.fixed(np.log(np.random.default_rng(3).dirichlet(np.ones(8), size=(8, 8))))
    other = searches.fixed(np.log(np.random.default_rng(4).dirichlet(np.ones(5), size=(5, 5))))
    words = [["t", "h", "i", "s"], ["abc", "cab"], ["a"], [], ["abcdefghij", "jihg"], ["xyz", "zxy"], ["aa", "bb", "ab"] * 3]
    texts = [(w, *m, seed) for w in words for m in ((letters, logp), (letters[:5], other)) for seed in (0, 1)]
    want = [co.Search(w, x, p).best(150, 3, seed) for w, x, p, seed in texts]
    made, best = [], searches.best
    monkeypatch.setattr(searches, "best", lambda some, *rest: made.append(len(some)) or best(some, *rest))
    assert co.searched(texts, 150, 3) == want
    assert made == [24]  # of 28, as abc cab and xyz zxy are of one pattern
    monkeypatch.setattr(searches, "SHORT", 5)
    assert co.searched(texts, 150, 3) == want


def test_pages_transcribed_in_their_rows_agree_with_the_steps(spark):
    from lexiforge.operators import images as im
    from lexiforge.plans import tables

    c = oc.corpus(tables.documents(spark, SF)).limit(40).unionByName(oc.corpus(made(spark, "", " ", "a")).withColumn("doc_id", F.col("doc_id") - 9))
    shown = oc.sample(c).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_idx", "unit"))), lambda x: x["unit"]), "\n").alias("text"))
    steps = im.transcribe(im.glyphs(im.drawn(shown)))
    here = im.transcribe_drawn(c.filter("size(units) > 0").select("doc_id", F.array_join(oc.first_units(), "\n").alias("text")))
    assert here.columns == steps.columns and "Exchange" not in im.transcribe_drawn(spark.range(2).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text")))._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(str, steps.collect()))
    assert sorted(map(str, here.collect())) == want and len(want) >= 40


def test_parts_and_blur_in_whole_arrays_agree_with_plain_ones():
    from lexiforge.operators import images as im

    r = np.random.default_rng(8)
    for h, w in ((1, 1), (1, 30), (30, 1), (25, 40), (40, 25)):
        grey = r.integers(0, 256, (h, w)).astype(np.uint8)
        assert (im.blurred_grey(grey) == np.rint(im.blurred(grey.astype(float)))).all()
        ink = r.random((h, w)) < 0.35
        parts, left = [], set(zip(*map(np.ndarray.tolist, np.nonzero(ink)), strict=True))
        while left:
            todo, part = [min(left)], set()
            left.discard(todo[0])
            while todo:
                y, x = todo.pop()
                part.add((y, x))
                near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                todo += near
            parts.append(part)
        least = max(4, np.median([len(p) for p in parts]) * 0.08) if parts else 0
        labels, boxes = im.components(ink)
        want = [[min(x for _, x in p), min(y for y, _ in p), max(x for _, x in p) + 1, max(y for y, _ in p) + 1, [n]] for n, p in enumerate(parts, 1) if len(p) >= least]
        assert boxes == want and all(labels[y, x] == n for n, p in enumerate(parts, 1) for y, x in p) and (labels > 0).sum() == ink.sum()


def test_equal_glyphs_count_once_towards_the_most(spark):
    from lexiforge.operators import images as im

    (r,) = im.transcribe_drawn(made(spark, "abcab " * 5), most=4).collect()
    assert r["n_glyph_tokens"] == 25 and r["n_sign_types"] == 3
    (r,) = im.transcribe(im.glyphs(im.drawn(made(spark, "abcab " * 5))), most=4).collect()
    assert r["n_glyph_tokens"] == 25 and r["n_sign_types"] == 3
