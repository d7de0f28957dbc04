"""Each operator against brute force, an exact round trip or planted cases; and the awkward inputs of all of them."""

import hashlib
import random
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.llm import bm25_packing, bt_quality, digest_index, flac_media, line_suffix, pitman_yor, prob_minhash, tiered_shards, token_cache, unigram_codec
from lexiforge.llm.common import crc_fold, workspace
from lexiforge.llm.queries import tokenizer

R = random.Random(5)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 7))) for _ in range(400)]
SCHEMA = "doc_id long, text string, source string, label string, score double, kept boolean, row int, hits int"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names might clash."""
    texts = [None, "", " ", "\n\n", "A b  c ", prose(60, 1), prose(60, 1), prose(60, 1).upper(), prose(9000, 2), "ünï ▁ 😀\tx\r\n y", "same line of text with ten words in it all right\n" * 3]
    rows = [(i, t, None, "x", None, None, 1, None) for i, t in enumerate(texts)]
    rows += [rows[5], (None, prose(40, 3), "s", None, 1.0, True, 2, 3), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def operators(spark):
    pieces, words = tokenizer("piece_bpe_32k.model"), tokenizer("word_bpe_49k.json")
    labels = spark.createDataFrame([(5, 1), (8, 0), (None, 1), (6, None)], "doc_id long, quality int")
    return {
        "bt": lambda d: bt_quality.score(d, bt_quality.fit(d, labels)),
        "codec": lambda d: unigram_codec.digest(d, pieces),
        "py": lambda d: pitman_yor.score_documents(d, crc_fold("doc_id", 5) == 1),
        "minhash": prob_minhash.near_duplicates,
        "flac": flac_media.digest,
        "count": lambda d: token_cache.count_tokens(d, pieces, workspace(spark, "t")),
        "lines": line_suffix.clean,
        "exact": lambda d: digest_index.deduplicate(d, digest_index.DigestIndex(spark, workspace(spark, "i"), buckets=4)),
    }


@pytest.mark.parametrize("name", ["bt", "codec", "py", "minhash", "flac", "count", "lines", "exact"])
def test_awkward_rows_each_give_a_row(spark, odd, empty, name):
    f = operators(spark)[name]
    assert f(odd).count() == odd.count()
    assert f(empty).count() == 0


CLASH = ["_d", "_h", "_row", "_runs", "_gone", "_text", "lines_deleted", "all_deleted", "bt_score", "group", "file", "_shard", "_shard_file", "_metadata", "key", "content", "node", "id", "class_id", "kept", "n_tokens"]


def test_columns_of_any_name_and_ids_of_any_size(spark, odd):
    big = [2**60 + 1, 2**60 + 3, None, -(2**62) - 1]
    rows = [(i, f"text of number {k} with some words", *[f"{c}{k}" for c in CLASH]) for k, i in enumerate(big)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASH)).coalesce(1)
    for name, f in operators(spark).items():
        got = [r["doc_id"] for r in f(docs).collect()]
        assert sorted(got, key=str) == sorted(big, key=str), name
    packed = bm25_packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))
    assert sorted([r["doc_id"] for r in packed.collect()], key=str) == sorted(big, key=str)
    cleaned = {r["doc_id"]: r for r in line_suffix.clean(docs).collect()}
    for r in docs.collect():
        assert all(cleaned[r["doc_id"]][c] == r[c] for c in ["text", *CLASH] if c not in ("lines_deleted", "all_deleted"))
        assert cleaned[r["doc_id"]]["lines_deleted"] == 0
    kept = prob_minhash.drop_near_duplicates(docs)
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    scored = bt_quality.score(docs, bt_quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int")))
    assert [c for c in scored.columns] == docs.columns and {r["bt_score"] for r in scored.collect()} == {1.0}
    store = tiered_shards.ShardStore(spark, workspace(spark, "s"), rows_per_shard=1, fan_in=2)
    store.append(docs)
    store.append(docs.limit(0))
    store.compact()
    assert sorted(map(str, store.read(column=None).select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert store.read().filter("_shard.rows = 4").count() == 4
    store = tiered_shards.ShardStore(spark, workspace(spark, "s"))
    store.append(odd)
    assert sorted(map(str, store.read(column=None).collect())) == sorted(map(str, odd.collect()))


def test_packing_of_awkward_rows(spark, odd, empty):
    words = tokenizer("word_bpe_49k.json")
    assert bm25_packing.pack_documents(empty, words).count() == 0
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(words)
    rows = [r for r in bm25_packing.pack_documents(odd, words, window=256).collect() if r["doc_id"] not in (None, 5)]
    for d in odd.collect():
        if d["doc_id"] not in (None, 5):
            ids = lib.encode(d["text"] or "", add_special_tokens=False).ids + [2]
            own = sorted((r for r in rows if r["doc_id"] == d["doc_id"]), key=lambda r: r["start"])
            assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
            for r, start in zip(own, np.cumsum([0] + [r["length"] for r in own]), strict=False):
                assert r["start"] == start and r["ids_crc32"] == zlib.crc32(np.array(ids[start : start + r["length"]], "<u4").tobytes())


def test_sequences_are_full_and_gapless(spark):
    docs = spark.createDataFrame([(i, prose(R.randint(1, 300), i)) for i in range(150)], "doc_id long, text string").coalesce(1)
    by = {}
    for r in bm25_packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), window=512, shard_bytes=40_000).collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    short = 0
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        short += at < 512
    assert short <= 5


def test_index_returns_bm25_order():
    docs = [np.array(x) for x in ([0, 1, 2, 3], [0, 1, 9, 8], [0, 7, 6, 5], [2, 3, 1, 4], [5, 6, 7, 8])]
    index = bm25_packing.InvertedIndex(docs, common=1.0)
    assert list(index.neighbours(0, np.array([False, True, True, True, True])))[0] == 3


def test_index_keeps_words_of_many_documents():
    r = random.Random(4)
    for n in (9, 60):  # few documents; and a third of them of one source
        docs = [[r.randrange(8) for _ in range(r.randint(3, 12))] + ([100 + r.randrange(12) for _ in range(9)] if d % 3 == 0 else [200 + r.randrange(40) for _ in range(9)]) for d in range(n)]
        df, mean = {w: sum(w in d for d in docs) for w in {w for d in docs for w in d}}, sum(map(len, docs)) / n
        index, unused = bm25_packing.InvertedIndex([np.array(d) for d in docs]), np.ones(n, bool)
        for seed in range(0, n, 4):
            unused[seed] = False
            index.forget(unused)
            score = {d: sum(np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * docs[d].count(w) * 2.2 / (docs[d].count(w) + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean)) for w in set(docs[seed]) if df[w] > 1) for d in np.flatnonzero(unused)}
            got = list(index.neighbours(seed, unused))
            assert sorted(got) == [d for d in score if score[d] > 0] and len(got)
            assert all(score[a] >= score[b] - 1e-5 for a, b in zip(got, got[1:], strict=False))
    words = [np.array([1, 2, 3, 4]) if d % 2 else np.array([5, 6, 7, 8]) for d in range(8)]
    first = [d for d, _, _, q, _ in bm25_packing.pack(np.full(8, 5), words, 20) if q == 0]
    assert first == [0, 2, 4, 6]


def test_viterbi_equals_brute_force():
    pieces = [("<unk>", 0.0, 2)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] + [(p, s, 1) for p, s in (("a", -3.0), ("b", -3.5), ("ab", -4.0), ("ba", -4.5), ("aba", -7.0), ("▁", -2.0), ("▁a", -4.2), ("▁ab", -5.5))]
    m = unigram_codec.UnigramModel(pieces)
    score = {p: s for p, s, k in pieces if k == 1}

    def best(t):
        return max((sum(score[x] for x in c) for c in cuts(t)), default=None)

    def cuts(t):
        if not t:
            yield []
        for i in range(1, len(t) + 1):
            if t[:i] in score:
                yield from ([t[:i], *c] for c in cuts(t[i:]))

    for n in range(1, 7):
        for t in map("".join, product("ab ", repeat=n)):
            ids = m.encode(t)
            assert abs(sum(m.scores[i] for i in ids) - best("▁" + t.replace(" ", "▁"))) < 1e-9 and m.decode(ids) == t
    assert m.decode(m.encode("aéb😀")) == "aéb😀" and sum(m.is_byte[i] for i in m.encode("é")) == 2


def test_token_counts_equal_the_library(spark, odd):
    import sentencepiece

    lib, path = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model")), workspace(spark, "t")
    want = {r["doc_id"]: len(lib.encode(r["text"] or "")) for r in odd.collect() if r["doc_id"] is not None}
    for _ in range(2):  # the second time from the cache
        got = {r["doc_id"]: r["n_tokens"] for r in token_cache.count_tokens(odd, tokenizer("piece_bpe_32k.model"), path).collect() if r["doc_id"] is not None}
        assert got == want
    assert token_cache.read_cache(spark, path).count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_flac_round_trip_damage_and_seeking():
    payloads = [flac_media.pad(x) for x in (b"", b"x" * 2000, R.randbytes(5000), prose(3000, 4).encode(), bytes(range(256)) * 9)]
    streams = flac_media.encode_streams(payloads)
    assert [((x + 128).astype(np.uint8)).tobytes() for x in flac_media.decode_streams(streams)] == payloads
    info, begin = flac_media.parse_metadata(streams[3])
    assert info["samples"] == len(payloads[3]) and info["points"]["sample"][2] == 2 * flac_media.BLOCK
    sample, at = flac_media.seek(streams[3], 1300)
    (x,), _, _ = flac_media.decode_frames(np.frombuffer(streams[3], np.uint8)[at:], np.array([0]), 8)
    assert ((x + 128).astype(np.uint8)).tobytes() == payloads[3][sample : sample + 576]
    bare = streams[3][:4] + bytes([0x80]) + streams[3][5:42] + streams[3][begin:]
    assert (flac_media.decode_streams([bare])[0] == flac_media.decode_streams([streams[3]])[0]).all()
    broken = bytearray(streams[3])
    broken[begin + 300] ^= 4
    with pytest.raises(ValueError):
        flac_media.decode_streams([bytes(broken)])


def test_exact_dedup_keeps_largest_and_persists(spark):
    path = workspace(spark, "i")
    docs = spark.createDataFrame([(1, "Ab"), (7, "aB"), (3, "ÀB"), (4, "àb"), (9, None), (2, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in digest_index.deduplicate(docs, digest_index.DigestIndex(spark, path, 4)).collect()}
    assert [got[i]["keep_id"] for i in (1, 7, 3, 4, 9, 2)] == [7, 7, 3, 4, 9, 9] and got[7]["kept"] and not got[1]["kept"]
    assert got[1]["text_sha256"] == hashlib.sha256(b"ab").hexdigest()
    again = spark.createDataFrame([(50, "AB"), (51, "new"), (52, "new")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in digest_index.deduplicate(again, digest_index.DigestIndex(spark, path, 4)).collect()}
    assert got == {50: (7, False), 51: (52, False), 52: (52, True)}


def test_line_runs_against_brute_force(spark):
    r = random.Random(3)
    lines = [" ".join(r.choice(WORDS[:30]) for _ in range(r.randint(1, 6))) for _ in range(12)]
    docs = [(i, "\n".join(r.choice(["", *lines]) for _ in range(r.randint(0, 14)))) for i in range(60)]

    def brute(m):
        seqs = [[(p, x) for p, x in enumerate(t.split("\n")) if x.strip(" ")] for _, t in docs]
        gone, seen = [set() for _ in docs], {}
        runs = [(d, i, n) for d, s in enumerate(seqs) for i in range(len(s)) for n in range(1, len(s) - i + 1)]
        for d, i, n in runs:
            key = tuple(x for _, x in seqs[d][i : i + n])
            if sum(len(x.split(" ")) for x in key) >= m:
                if seen.setdefault(key, (d, i)) < (d, i):
                    gone[d] |= set(range(i, i + n))
        return {docs[d][0]: len(g) for d, g in enumerate(gone)}

    got = {x["doc_id"]: x["lines_deleted"] for x in line_suffix.clean(spark.createDataFrame(docs, "doc_id long, text string"), min_words=10).collect()}
    assert got == brute(10)


def test_line_runs_without_spaces(spark):
    passage = "漢字文章" * 80  # 320 signs are 14 words
    docs = spark.createDataFrame([(1, f"a\n{passage}\nb"), (2, f"c\n{passage}\n\t"), (3, "one\ttwo\tthree\tfour\tfive\tsix\tseven\teight\tnine\tten"), (4, "one\ttwo\tthree\tfour\tfive\tsix\tseven\teight\tnine\tten")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lines_deleted"], r["text"], r["all_deleted"]) for r in line_suffix.clean(docs).collect()}
    assert got[1][0] == got[3][0] == 0 and got[2] == (1, "c\n\t", False) and got[4] == (1, "", True)


def test_near_duplicates_against_brute_force(spark):
    r, docs = random.Random(8), []
    for g in range(12):
        base = prose(150, 100 + g).split(" ")
        docs.append((len(docs), " ".join(base)))
        for _ in range(g):
            copy = list(base)
            for _ in range(r.randint(0, 5)):
                copy[r.randrange(len(copy))] = "edited" + str(r.random())
            docs.append((len(docs), " ".join(copy)))
    sets = [{tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(len(docs)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {x["doc_id"]: x for x in prob_minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i: got[i]["class_id"] for i in got} == {i: find(i) for i in range(len(docs))}
    assert sorted(i for i in got if got[i]["kept"]) == sorted({find(i) for i in range(len(docs))})
    kept = prob_minhash.drop_near_duplicates(spark.createDataFrame([*docs, docs[0]], "doc_id long, text string"))
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted({find(i) for i in range(len(docs))})


def test_near_duplicates_with_repeats_and_low_estimates(spark):
    docs = []
    for g in range(30):
        base = [f"w{g}x{i}" for i in range(200)]
        docs += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base + base[140:] * 20))]  # set similarity 0.98
    got = {x["doc_id"]: x["class_id"] for x in prob_minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(60)}

    member = spark.createDataFrame([(0, 1, "a"), (0, 1, "b"), (0, 1, "c")], "band int, h long, node string")
    same, other = prob_minhash.marks(np.arange(50, dtype=np.uint64)).tolist(), prob_minhash.marks(np.arange(25, 75, dtype=np.uint64)).tolist()
    nodes = spark.createDataFrame([("a", 50, [1], [0] * 8, same), ("b", 50, [1], [-1] * 8, same), ("c", 50, [1], [-1] * 8, other)], "node string, n int, bands array<long>, brief array<long>, marks array<long>")
    root = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c")], "node string, root string")
    # no component of the signatures agrees, and yet the pair is compared; only a pair that cannot be similar is not
    assert [tuple(x) for x in prob_minhash._across(member, nodes, root, 0.8, -1.0, 0.7, 125).collect()] == [("a", "b")]


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    est = []
    for _ in range(60):
        e = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = prob_minhash.signature(e[:250], np.ones(250), 125), prob_minhash.signature(e[50:], np.ones(250), 125)
        est.append((a == b).mean())
    assert abs(np.mean(est) - 200 / 300) < 0.02


def test_signatures_do_not_depend_on_the_documents_beside():
    rng = np.random.default_rng(2)
    words = [[f"w{x}" for x in rng.integers(0, 400, n)] for n in (0, 1, 4, 5, 6, 60, 70, 300, 4000, 0, 90)]
    sets = prob_minhash.shingles(prob_minhash.word_hashes([w for d in words for w in d]), np.array([len(d) for d in words]), 5)
    assert [len(e) for e in sets] == [len({tuple(d[i : i + 5]) for i in range(max(len(d) - 4, min(len(d), 1)))}) for d in words]
    for d, e, s in zip(words, sets, prob_minhash.signatures(sets, 125), strict=True):
        alone = prob_minhash.shingles(prob_minhash.word_hashes(d), np.array([len(d)]), 5)[0]
        assert np.array_equal(alone, e) and np.array_equal(prob_minhash.signature(e, np.ones(len(e)), 125), s)


def test_shards_keep_rows_versions_and_refuse_conflicts(spark):
    store = tiered_shards.ShardStore(spark, workspace(spark, "s"), target_bytes=60_000, small_bytes=2_000, rows_per_shard=10)
    for k in range(3):
        store.append(spark.createDataFrame([(i, prose(80, i)) for i in range(100 * k, 100 * k + 100)], "doc_id long, text string"))
    before = store.manifest().count()
    with pytest.raises(Exception):  # noqa: B017
        store.commit(store.manifest(), store.version())
    assert store.version() == 3
    store.compact()
    assert sorted(r["doc_id"] for r in store.read(3).collect()) == list(range(300))  # old versions stay
    assert store.vacuum(keep=1) > 0 and store.vacuum(keep=1) == 0
    with pytest.raises(ValueError):
        store.read(3)
    assert store.version() > 3 and store.manifest().count() < before
    rows = store.read()
    assert sorted(r["doc_id"] for r in rows.collect()) == list(range(300))
    assert {r["doc_id"]: r["text"] for r in rows.collect()}[123] == prose(80, 123)


def test_quality_ranks_held_out(spark):
    docs = [(i, prose(80, i) if i % 3 else prose(30, i).upper().replace(" ", "!! ")) for i in range(240)]
    labels = [(i, 1 if i % 3 else 0) for i, _ in docs]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = bt_quality.fit(d, lab, learn=crc_fold("key", 3) != 1)
    got = {r["doc_id"]: r["bt_score"] for r in bt_quality.score(d, model).filter(crc_fold("doc_id", 3) == 1).collect()}
    assert got and all((s >= 0.5) == (i % 3 > 0) for i, s in got.items())


def test_quality_threshold_is_that_of_all_labelled_rows(spark):
    docs = [(i, prose(40 + i % 9, i) + ("! " * (i % 5) if i % 10 else "! " * (i % 7))) for i in range(600)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 10 > 0)) for i, _ in docs], "doc_id long, quality int")
    for most in (40, 8000):  # the classes are sampled 40 to 40, or whole
        scores = [r["bt_score"] for r in bt_quality.score(d, bt_quality.fit(d, lab, max_labelled=most)).collect()]
        assert abs(sum(s < 0.5 for s in scores) - 60) <= 2
    s = spark.createDataFrame([(float(v),) for v in [5, 5, 5, 1, -3, 1e9, 2, 2]], "s double")
    assert [bt_quality.order_statistic(s, "s", k) for k in range(8)] == [-3, 1, 2, 2, 5, 5, 5, 1e9]


def test_language_model_counts_and_normalises(spark):
    docs = [(i, f"the {WORDS[i % 40]} of {WORDS[i % 7]}  The\n{WORDS[(3 * i) % 50]}") for i in range(200)]
    got = {r["doc_id"]: r for r in pitman_yor.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), crc_fold("doc_id", 5) == 1, block_bytes=1500).collect()}
    toks = {i: [*t.encode().lower().split(), b""] for i, t in docs}
    train = [w for i in toks if zlib.crc32(str(i).encode()) % 5 != 1 for w in toks[i]]
    n, count = len(train), {w: train.count(w) for w in set(train)}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1) and r["n_tokens"] == len(toks[i]) and r["train_tokens"] == n
        assert r["n_known"] == sum(w in count for w in toks[i])
        assert abs(r["base_score"] - sum(np.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (len(count) + 1))) for w in toks[i])) < 1e-6
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_first_seats_give_the_formula_and_perplexity_falls(spark):
    docs = [(i, f"the {WORDS[i % 9]} of {WORDS[(i * 5) % 7]} the {WORDS[i % 9]} of" if i % 6 else None) for i in range(120)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score_documents(d, crc_fold("doc_id", 5) == 1, sweeps=0, samples=1, block_bytes=700).collect()}
    texts = {i: [w.lower() for w in (t or "").split()] + [""] for i, t in docs}
    c, customers = {}, {}
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for u, w in zip([None, *t], t, strict=False):
                c[u, w] = c.get((u, w), 0) + 1
    for _, w in c:
        customers[w] = customers.get(w, 0) + 1  # one table in each context's restaurant
    cu, tu = {}, {}
    for (u, _), n in c.items():
        cu[u], tu[u] = cu.get(u, 0) + n, tu.get(u, 0) + 1
    n = list(c.values())
    discount = min(0.95, max(0.05, n.count(1) / max(1, n.count(1) + 2 * n.count(2))))
    m = list(customers.values())
    top_discount = min(0.95, max(0.05, m.count(1) / max(1, m.count(1) + 2 * m.count(2))))

    def p(u, w):
        base = (1 + top_discount * len(m)) / (len(m) + 1)
        p0 = ((customers[w] - top_discount if w in customers else 0) + base) / (1 + sum(m))
        return (max(c.get((u, w), 0) - discount, 0) + (1 + discount * tu.get(u, 0)) * p0) / (1 + cu.get(u, 0))

    for i, t in texts.items():
        assert abs(got[i] - sum(np.log10(p(u, w)) for u, w in zip([None, *t], t, strict=False))) < 1e-3
    sampled = pitman_yor.perplexity(pitman_yor.score_documents(d, crc_fold("doc_id", 5) == 1, block_bytes=700)).filter("held_out").first()
    assert 1 < sampled["perplexity"] < 0.5 * sampled["base_perplexity"]


def test_parent_probabilities_sum_to_one():
    level = pitman_yor.Level([30.0, 9.0, 5.0, 40.0, 4.0, 2.0, 3.0, 1.0])
    customers, tables = np.array([10.0, 8, 6, 4, 2]), np.array([3.0, 2, 2, 1, 1])
    assert abs(level.parent(customers, tables).sum() + level.unknown - 1) < 1e-12
    t = pitman_yor.seat(np.array([1, 2, 500, 100_000]), np.array([0.1, 0.2, 0.3, 0.4]), 0.5, np.random.default_rng(0))
    assert t[0] == 1 and (t >= 1).all() and t[3] > t[2] and t[3] < 5000
