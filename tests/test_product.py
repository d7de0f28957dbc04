"""Files in, reports out; sign values, images and hypotheses on texts made here."""

import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge import __main__ as cli
from lexiforge.functions import text as ft
from lexiforge.operators import claims as cl
from lexiforge.operators import compare as co
from lexiforge.operators import corpus as oc
from lexiforge.operators import hypotheses as hy
from lexiforge.operators import images as im
from lexiforge.operators import language as lg
from lexiforge.operators import report
from lexiforge.operators import statistics as st
from lexiforge.operators.staging import staged
from lexiforge.sources import loader

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def known(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")


@pytest.fixture(scope="module")
def freq(known):
    return staged(lg.frequencies(known))


def english(known, n):
    return " ".join(r["text"] for r in known.filter("lang = 'en'").orderBy("doc_id").limit(n).collect())


def test_files_of_each_kind(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("\ufeffh\u00e9llo".encode("utf-8"))
    (tmp_path / "b.md").write_bytes("h\u00e9llo".encode("utf-16"))
    (tmp_path / "c").write_bytes("h\u00e9llo".encode("latin-1"))
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:tbl><w:p><w:r><w:t>no</w:t></w:r></w:p></w:tbl><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "e.docx").write_bytes(b"no archive")
    (tmp_path / "f.PNG").write_bytes(b"pixels")
    (tmp_path / "g.txt").write_text("password = hunter22 and more")
    got = {r["name"]: r for r in loader.safe(loader.load(spark, str(tmp_path))).collect()}
    assert [got[n]["text"] for n in ("a.txt", "b.md", "c")] == ["h\u00e9llo"] * 3
    assert [got[n]["encoding"] for n in ("a.txt", "b.md", "c")] == ["utf-8", "utf-16", "latin-1"] and got["c"]["notes"]
    assert got["d.docx"]["text"] == "one two\nthree" and "cannot be read" in got["e.docx"]["notes"][0]
    assert got["f.PNG"]["kind"] == "image" and len(got["f.PNG"]["images"]) == 1
    assert "hunter22" not in got["g.txt"]["text"] and "1 strings" in got["g.txt"]["notes"][0]
    (tmp_path / "h.json").write_text('[{"type": "gloss", "token": "a", "meaning": "B", "anchor": "numbers"}, {"type": "role", "token": "x", "role": "name"}]')
    assert loader.command_lines(spark, str(tmp_path / "h.json")) == ["gloss a = B near numbers", "role x name"]


def test_reports_of_both_tiers(spark, known, freq, tmp_path):
    secret = "api_key = sk-ant-abcdefghijklmnop"
    (tmp_path / "known.txt").write_text(english(known, 3) + "\n" + secret)
    r = random.Random(3)
    (tmp_path / "strange.txt").write_text("\n".join(" ".join("".join(chr(0xE000 + r.randrange(26)) for _ in range(r.randint(2, 7))) for _ in range(9)) for _ in range(40)))
    docs = loader.load(spark, str(tmp_path))
    names = {x["doc_id"]: x["name"] for x in docs.collect()}
    reports, results = report.analyze(docs, freq, staged(lg.trigram_model(known)), ["gloss zz = THING near numbers", "nonsense"])
    got = {names[x["doc_id"]]: x for x in reports.collect()}
    assert got["known.txt"]["tier"] == 1 and "English" in got["known.txt"]["report"] and "sk-ant" not in got["known.txt"]["report"]
    assert got["strange.txt"]["tier"] == 2 and "random-like" in got["strange.txt"]["report"] and "UNTESTABLE" in got["strange.txt"]["report"] and "P0" in got["strange.txt"]["report"]
    for title in ("2. Signs", "3. Statistics", "4. Structure", "5. Other", "6. How", "7. Next"):
        assert f"## {title}" in got["strange.txt"]["report"]
    report.write(reports, results, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/results")).count() == 2


def test_a_cipher_is_read(spark, known, freq):
    plain = " ".join(w for w in english(known, 40).lower().split() if w.isascii() and w.isalpha())[:9000]
    shuffled = random.Random(7).sample(range(26), 26)
    key = {chr(97 + i): chr(0xE000 + k) for i, k in enumerate(shuffled)}
    docs = spark.createDataFrame([(1, "".join(key.get(c, c) for c in plain))], "doc_id long, text string")
    lex = staged(lg.lexicon(freq))
    (r,) = co.decipher(oc.corpus(docs), ["en", "xx"], staged(co.letter_counts(lex)), lex, iterations=3000).collect()
    used = [c for c in key if c in plain]
    right = sum(r["mapping"].get(key[c]) == c for c in used)
    assert right / len(used) > 0.8 and r["hit_rate"] > 3 * max(r["control_rate"], 0.01) and r["strong"]


def test_dense_model_agrees_with_the_table(spark, freq):
    counts = staged(co.letter_counts(lg.lexicon(freq)))
    letters, logp = co.dense_model(counts.filter("lang = 'en'").toPandas())
    at = {x: i for i, x in enumerate(letters)}
    rows = co.letter_model(counts).filter("lang = 'en'").collect()
    assert rows and all(abs(logp[at[r["a"]], at[r["b"]], at[r["c"]]] - r["logp"]) < 1e-5 for r in rows)
    assert np.isfinite(logp).all()


def test_fuzzy_matches_by_hand(spark):
    index = co.deletion_index(spark.createDataFrame([("en", 1, "house"), ("en", 2, "horse"), ("en", 3, "of")], "lang string, rank int, word string"))
    words = spark.createDataFrame([("en", w) for w in ("h\u00f4use", "huose", "hous", "hores", "xyz")], "lang string, word string")
    got = {r["word"]: r["match"] for r in co.near_matches(words, index).collect()}
    assert got == {"h\u00f4use": "house", "huose": "house", "hous": "house", "hores": "horse"}


def test_unspaced_texts(spark):
    r = random.Random(1)
    words = [("abcdefgh" * 2)[i : i + r.randint(3, 6)] for i in [r.randrange(8) for _ in range(60)]]
    text = "x".join(r.choice(words) for _ in range(400))
    c = {x["doc_id"]: x for x in oc.corpus(spark.createDataFrame([(1, text), (2, "".join(words)), (3, ""), (4, "a b")], "doc_id long, text string")).collect()}
    assert c[1]["separator"] == "sign x" and c[1]["units"][0][0] in words and c[1]["unit_kind"] == "12-token window" and len(c[1]["units"][0]) == 12
    assert c[2]["separator"] == "none" and c[4]["separator"] == "whitespace"
    docs = oc.corpus(spark.createDataFrame([(1, "".join(words) * 3)], "doc_id long, text string"))
    assert st.divider_like_signs(oc.tokens(docs), docs).count() == 0 and st.signs_per_word(docs).first()["signs_per_word"] is None


def test_values_and_counterexamples(spark):
    c = staged(oc.corpus(spark.createDataFrame([(1, "\n".join(["cab 7 bad", "cab 9 dab", "bad cab"] * 5))], "doc_id long, text string")))
    t = oc.tokens(c)
    got = hy.counterexamples(c, c, t, ["gloss cab = X near numbers"]).collect()
    assert [r["unit"] for r in got] == ["bad cab"] * 3
    lex = spark.createDataFrame([("en", "cab"), ("en", "bad"), ("en", "dab")], "lang string, word string")
    lines = ["values a=a b=b c=c d=d in en", "values a=a b=b c=c d=d in xx", "values q=a in en"]
    v = {r["hyp"]: r for r in hy.values_test(c, t, lines, lex).collect()}
    assert v[0]["rate"] == 1.0 and v[0]["null_mean"] < 0.7 and v[0]["verdict"] != "UNTESTABLE" and v[1]["verdict"] == v[2]["verdict"] == "UNTESTABLE"
    d = {r["hyp"]: r["verdict"] for r in hy.verdicts(c, c, t, ["gloss cab = X near numbers", "what"], lex).collect()}
    assert d == {0: "PARTLY CONSISTENT", 1: "UNTESTABLE"}


def test_labels_both_ways(spark):
    signs = [chr(0xE005), chr(0xE000 + 999) + chr(0xF0000 + 7), "Ab"]
    d = spark.createDataFrame([(s,) for s in signs], "s string").select("s", ft.show(F.col("s")).alias("l")).select("s", "l", ft.parse_label(F.col("l"), F.lit(True)).alias("b")).collect()
    assert [r["l"] for r in d] == ["P005", "P999-G007", "Ab"] and [r["b"] for r in d] == [*signs[:2], "ab"]


def test_images_become_texts(spark):
    text = "\n".join(["abc abd ca bdac cab dab", "bc abd ca bdac cab dab", "c abd ca bdac cab dab", "abd ca bdac cab dab", "bd ca bdac cab dab"])
    g = im.glyphs(im.drawn(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string"))).cache()
    (r,) = im.transcribe(g).collect()
    pairs = set(zip(text, r["text"], strict=True))
    assert len(pairs) == len({a for a, _ in pairs}) == 6 and r["n_sign_types"] == 4 and r["n_lines"] == 5 and r["direction"] == "left-to-right"
    sheet = im.sign_sheet(g).collect()
    assert [s["sign"] for s in sheet] == ["G000", "G001", "G002", "G003"] and sum(s["uses"] for s in sheet) == r["n_glyph_tokens"]
    assert im.word_gap(np.array([2, 2, 3, 2, 9, 9])) == 9.0 and im.word_gap(np.array([2, 2, 3])) is None


def test_sessions_and_claims(spark, known):
    said = []
    assert cli.session(["help", "", "role a name", "quit", "role b name"], lambda line: ("CONSISTENT", line), said.append) == 1 and said[-1] == "[HYPOTHESIS] CONSISTENT: role a name"
    docs = known.orderBy("doc_id").limit(6).select("doc_id", "text")
    f = cl.find(docs)
    c = staged(cl.claims(f))
    assert {r["method"] for r in c.collect()} == {"inventory", "statistics", "structure", "comparison"}
    n = report.tally(c).groupBy().sum("observed", "inferred", "hypotheses").first()
    assert sum(n) == c.count()
    with pytest.raises(ValueError):
        ft.claim("SURE", F.lit(""))
