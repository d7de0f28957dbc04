"""One pass over a document's row against the operators over tables of tokens."""

from pyspark.sql import functions as F

from lexiforge.operators import claims as cl
from lexiforge.operators import compare as co
from lexiforge.operators import corpus as oc
from lexiforge.operators import findings as fi
from lexiforge.operators import hypotheses as hy
from lexiforge.operators import language as lg
from lexiforge.operators import statistics as st
from lexiforge.operators import structure as ms
from lexiforge.operators.staging import staged
from lexiforge.operators.wordforms import found

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", "   \n ", "a", "Ab", "...", "12 12 12", "x y  z", "Iİ ſß Straße straße ΟΔΟΣ οδος\r\n\r\nnew Line Line", "abcdefabcabcddd" * 9,
    "We saw Rome. We saw Rome again, \"Rome\" and (Paris) or Paris: Paris!\n" * 5, "5 sheep 12 sheep 7 goats 12 sheep 3 sheep and goats 4 goats 9 sheep x\n" * 7,
    "then they all sold 12 sheep at the market in town and saw no more\n" * 6,
    "\U0001f600 \U00010400\U00010428   tok" * 8, "iii ooo iii xx i i i i i i\n" * 6, "אב ג شم " * 9,
    "start walking started walked starts walker walkers talk talked talking talks talker end\nstart jump jumped jumping jumps jumper end\nstart look looked looking looks looker end\n" * 3,
]


def same(a, b):
    columns = sorted(b.columns)
    key = lambda d: sorted(map(repr, (tuple(r) for r in d.select(*columns).collect())))
    assert key(a) == key(b) and a.count()


def test_a_row_gives_what_its_tokens_give(spark):
    known = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame(list(enumerate(ODD, 10**6)), "doc_id long, text string")
    docs = staged(known.filter("doc_id % 8 = 0").select("doc_id", "text").unionByName(odd))
    lex = staged(lg.lexicon(lg.frequencies(known)))
    f = cl.find(docs, lex)
    assert f.rows.count() == docs.count()
    whole = staged(oc.corpus(docs))
    c, t = whole.drop("raw"), staged(oc.tokens(whole))
    forms = staged(found(c))
    affixes = fi.affix_control(forms)
    words = fi.words_only(t).join(affixes.select("doc_id"), "doc_id", "left_semi")
    for now, tables in (
        (f.inventory, st.sign_inventory(t)), (f.per_word, st.signs_per_word(c)), (f.words, st.word_statistics(t)), (f.zipf, st.zipf_fit(t)), (f.verdict, st.structure(c)),
        (f.dividers.drop("rk"), st.divider_like_signs(t, c)), (f.affixes, affixes), (f.endings.filter("rk <= 12"), ms.affix_scores(words)), (f.beginnings, ms.affix_scores(words, reverse=True)),
        (f.signatures, fi.controlled_signatures(t, c, forms)), (f.functions, fi.function_words(forms)), (f.order, fi.word_order(forms)), (f.positions, ms.positional(t)),
        (f.numerals.drop("rk"), ms.numeral_signs(t)), (f.number_words, ms.number_context(t)), (f.scripts, lg.script_shares(docs)), (f.direction, lg.script_profile(docs)),
    ):
        same(now, tables)
    cased = fi.cased_names(whole, t).select("doc_id", "rk", F.col("name").alias("word"), "c")
    plain = fi.uninflected_names(t, c, forms).join(c.filter("NOT has_case").select("doc_id"), "doc_id", "left_semi").select("doc_id", "rk", F.col("token").alias("word"), "c")
    same(f.names, cased.unionByName(plain))
    same(f.closest, co.closest(co.doc_profile(t, affixes), co.reference_profiles(lex)))
    languages = co.compared_languages(co.closest(co.doc_profile(t, affixes), co.reference_profiles(lex), None)).join(f.direction.filter("unknown_share < 0.2 AND letters > 0").select("doc_id"), "doc_id", "left_semi")
    same(f.lexical, co.lexical_matching(c, languages, staged(co.deletion_index(lex))))


def test_commands_are_tested_in_each_row(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    c = staged(oc.corpus(docs))
    lines = ["gloss sheep = SHEEP near numbers", "gloss x = X near y", "gloss start = GO near line_start", "gloss end = STOP near line_end", "gloss 12 = N", "role walked name", "role end unit_end", "role 12 number", "role start function_word", "role rome name", "role a verb"]
    for out in (hy.gloss_test(c, c, lines), hy.role_test(c, c, lines)):  # no row leaves its place
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    units = {r["doc_id"]: r["units"] for r in c.collect()}
    inflected = {r["doc_id"]: set(r["inflected"]) for r in found(c).collect()}
    assert any("walked" in x for x in inflected.values())
    gloss = {(r["doc_id"], r["hyp"]): r for r in hy.gloss_test(c, c, lines).collect()}
    roles = {(r["doc_id"], r["hyp"]): r for r in hy.role_test(c, c, lines).collect()}
    assert len(gloss) == 5 * len(ODD) and len(roles) == 6 * len(ODD)
    for d, us in units.items():
        n = sum(map(len, us))
        for hyp, word, at in ((2, "start", 0), (3, "end", -1)):
            uses = sum(u.count(word) for u in us)
            assert gloss[d, hyp]["occurrences"] == uses and gloss[d, hyp]["rate"] == (round(sum(u[at] == word for u in us) / uses, 3) if uses else None)
            assert gloss[d, hyp]["chance"] == (round(len(us) / n, 3) if uses else None)
        x = [i for u in us for i, w in enumerate(u) if w == "x" and "y" in u[max(0, i - 1) : i] + u[i + 1 : i + 2]]
        assert (gloss[d, 1]["rate"] or 0) * gloss[d, 1]["occurrences"] == len(x) and gloss[d, 4]["verdict"] == "UNTESTABLE"
        for hyp, word in ((5, "walked"), (8, "start"), (9, "rome")):
            r, at = roles[d, hyp], [i for i, u in enumerate(us) for w in u if w == word]
            still = word not in inflected[d]
            want = [len(at) / n > 0.005, len({i * 10 // len(us) for i in at}) >= 7, still] if word == "start" and at else [2 <= len(at) <= 10, still, (at[-1] - at[0]) * 10 <= len(us) * 3] if at else None
            assert r["occurrences"] == len(at) and (r["passed"], r["checks"]) == ((sum(want), 3) if want else (None, None))
        assert roles[d, 10]["verdict"] == "UNTESTABLE"
