"""Hierarchical Pitman-Yor language model with seating by Gibbs sampling, trained and applied block-wise.

Tokens are words (ASCII white space separates them, A-Z is lower-cased) and an end for each text. A word's context restaurant is
that of the word before it in its text (a text's first word has a context of its own). All context restaurants share one
parent, the word restaurant, whose base is uniform over the V known words and one unknown. A sweep takes each dish's
customers out of its restaurant and seats them again one by one by the Chinese-restaurant rule, given all
other seats; the first 64 in single steps, later ones in steps of an eighth of their number. Discounts are
n1 / (n1 + 2 n2) of the level's customers. Predictive probabilities are averaged over the kept sweeps.

Data flow: a narrow pass packs documents in blocks of bounded bytes and counts each block's (word, context)
pairs; the counts are dealt by word hash to shards, so that the dishes of one word are together and a frequent context is spread
over all shards. What a context's restaurant holds in all is summed between sweeps: each shard sends its contexts' customers
and tables, cut in ranges of the context, and gets the totals back. Probabilities go back to the blocks that asked, and blocks
score their texts. Words are known by 64-bit hashes, contexts by 36 bits of the word's hash (unlike words share a
context restaurant once in 7e10). Nothing is broadcast but eight sums.

Defined results: null counts as empty, whose one token is the end; a null id is learnt from; repeated rows
count each; with no training text every word is unknown; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import discard, from_worker, materialise, release, remove, to_worker, total_bytes, trim

BITS = 36
MASK = (1 << BITS) - 1
PACKED = "block long, shard int, words binary, sizes binary, contexts binary, counts binary"


def context_code(hashes: np.ndarray) -> np.ndarray:
    """The context restaurants of words by their hashes."""
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


#: The context of a text's first word: that of a space, which no word has.
NOTHING = int(context_code(np.array([xxhash.xxh3_64_intdigest(b" ")], np.uint64))[0])


def squeeze(x: np.ndarray, kind: str, ascending: bool = False) -> bytes:
    """An array as compressed planes of its bytes; ascending integers as their differences."""
    x = np.ascontiguousarray(x, dtype=kind)
    if ascending:
        x = np.diff(x, prepend=x.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def open_up(raw: bytes, kind: str, ascending: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    x = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if ascending else x


class Counted:
    """The tokens of a block of texts as places in its vocabulary, and their contexts."""

    def __init__(self, texts: list[bytes]):
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        number[b""]  # the end
        parts, self.sizes = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            words = t.lower().split()
            parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            parts.append(np.zeros(1, np.int32))
            self.sizes[i] = len(words) + 1
        self.tokens = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        del parts
        words = list(number)
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        self.contexts = context_code(self.hashes)[np.concatenate([self.tokens[:1], self.tokens[:-1]])]
        self.contexts[np.cumsum(self.sizes) - self.sizes] = NOTHING

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(word << BITS | context, sorted by the words' hashes then contexts; where each token's pair is)."""
        self.rank = np.empty(len(self.hashes), np.int64)
        self.order = np.argsort(self.hashes)
        self.rank[self.order] = np.arange(len(self.hashes))
        return np.unique(self.rank[self.tokens] << BITS | self.contexts, return_inverse=True)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash, so a block's words in order of hash are in order of shard."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _blocks(docs: DataFrame, block_bytes: int, shards: int) -> DataFrame:
    """Rows of two kinds: a block's texts (shard -1, in `words`), and its words and pairs for one shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def flush() -> pd.DataFrame:
            texts = [t for _, _, _, t in held]
            c = Counted(texts)
            pair, place = c.pairs()
            learnt = np.repeat(np.array([not out for _, _, out, _ in held]), c.sizes)
            count = np.bincount(place[learnt], minlength=len(pair)).astype("<u4")
            word, context = pair >> BITS, (pair & MASK).astype("<u8")
            hashes = c.hashes[c.order]
            of = shard_of(hashes, shards)
            cut = np.searchsorted(of, np.arange(shards + 1))
            pcut = np.searchsorted(word, cut)
            per = np.bincount(word, minlength=len(hashes)).astype("<u4")
            rows = [(block, -1, zstandard.ZstdCompressor(level=1).compress(pack_texts(held)), None, None, None)]
            for s in np.unique(of):
                a, b, x, y = cut[s], cut[s + 1], pcut[s], pcut[s + 1]
                rows.append((block, int(s), squeeze(hashes[a:b], "<u8", True), squeeze(per[a:b], "<u4"), squeeze(context[x:y], "<u8"), squeeze(count[x:y], "<u4")))
            return pd.DataFrame(rows, columns=["block", "shard", "words", "sizes", "contexts", "counts"])

        for b in batches:
            for row, key, out, t in zip(b["row"], b["key"], b["held_out"], b["content"], strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                if held and size + len(raw) > block_bytes:
                    yield flush()
                    held, size, block = [], 0, block + 1
                    trim()
                held.append((row, key, bool(out), raw))
                size += len(raw)
        if held:
            yield flush()

    return docs.mapInPandas(run, PACKED)


def pack_texts(rows: list[tuple]) -> bytes:
    """Row numbers, ids (with nulls), held-out flags, and texts of a block as bytes."""
    import pickle

    return pickle.dumps([tuple(x) for x in zip(*rows, strict=True)], protocol=5)


def unpack_texts(raw: bytes) -> list[tuple]:
    import pickle

    return list(zip(*pickle.loads(raw), strict=True))


def seat(c: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating c customers of each dish: a customer opens one with odds weight : (seated - discount * tables).

    weight is (strength + discount * the restaurant's other tables) * the parent's probability of the dish.
    """
    order = np.argsort(-c, kind="stable")
    size, w = c[order], weight[order].astype(np.float64)
    t = np.minimum(size, 1).astype(np.float64)
    n = 1
    live = int(np.searchsorted(-size, -n, side="left"))  # dishes with more than n customers
    while live:
        step = 1 if n < 64 else n // 8
        x = np.minimum(step, size[:live] - n)
        opens = w[:live] / (w[:live] + np.maximum(n - discount * t[:live], 1e-12))
        t[:live] += (rng.random(live) < opens) if step == 1 else rng.binomial(x, np.minimum(opens, 1.0))
        n += step
        live = int(np.searchsorted(-size, -n, side="left"))
    out = np.empty(len(c))
    out[order] = np.minimum(t, size)
    return out


STATE = "shard int, seen binary, sizes binary, contexts binary, counts binary, tables binary, top_tables binary, kept binary, kept_top binary, kept_back binary, ctx binary, ctx_n binary, ctx_t binary, scalars binary"
ASKED = "block long, shard int, words binary, sizes binary, contexts binary"
DEALT = f"kind string, block long, words binary, {STATE}"
SHARED = "shard int, bucket int, n binary, t binary"
DONE = "shard int, seen binary, sizes binary, contexts binary, p binary, tops binary, backs binary"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _f(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, dtype="<f4").tobytes()


def _sums(at: np.ndarray, contexts: int, count: np.ndarray, tables: np.ndarray, top: np.ndarray, customers: np.ndarray, seen: np.ndarray) -> dict[str, bytes]:
    """Customers and tables of a shard's contexts; and customers, tables of the parent, words, tokens, and n1, n2 of both levels."""
    n = [customers.sum(), top.sum(), np.count_nonzero(seen), seen.sum(), np.count_nonzero(count == 1), np.count_nonzero(count == 2), np.count_nonzero(customers == 1), np.count_nonzero(customers == 2)]
    return {"ctx_n": squeeze(np.bincount(at, count, contexts), "<u4"), "ctx_t": squeeze(np.bincount(at, tables, contexts), "<u4"), "scalars": np.array(n, "<f8").tobytes()}


def _begin(key, rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's first state, counts of all blocks together with one table for each dish of a restaurant, and what blocks will ask.

    Words and contexts that any block names here, learnt or not, are numbered in order of hash; states and questions have
    the numbers. A block's texts pass as they are.
    """
    if rows["shard"].iloc[0] < 0:
        return rows[["block", "words"]].assign(kind="text").reindex(columns=_names(DEALT))
    shard = int(rows["shard"].iloc[0])
    words = [open_up(x, "<u8", True) for x in rows["words"]]
    sizes = [open_up(x, "<u4").astype(np.int64) for x in rows["sizes"]]
    contexts = [open_up(x, "<u8").astype(np.int64) for x in rows["contexts"]]
    hashes, of_word = np.unique(np.concatenate(words), return_inverse=True)
    ctx, of_context = np.unique(np.concatenate(contexts), return_inverse=True)
    count = np.concatenate([open_up(x, "<u4") for x in rows["counts"]]).astype(np.int64)
    learnt = count > 0
    pair, at = np.unique((np.repeat(of_word, np.concatenate(sizes)) << 32 | of_context)[learnt], return_inverse=True)
    c = np.bincount(at, count[learnt], len(pair)).astype(np.int64) if len(pair) else np.zeros(0, np.int64)
    word, context = pair >> 32, pair & 0xFFFFFFFF
    per = np.bincount(word, minlength=len(hashes))
    seen = np.bincount(word, c, len(hashes))
    ones, top = np.ones(len(c)), np.minimum(per, 1)
    state = {
        "kind": "state", "shard": shard, "seen": squeeze(seen, "<u8"), "sizes": squeeze(per, "<u4"), "contexts": squeeze(context, "<u4"), "counts": squeeze(c, "<u4"), "tables": squeeze(ones, "<u4"), "top_tables": squeeze(top, "<u4"),
        "kept": b"", "kept_top": b"", "kept_back": b"", "ctx": squeeze(ctx, "<u8", True), **_sums(context, len(ctx), c, ones, top, per, seen),
    }
    out, w, x = [state], 0, 0
    for block, own, size, context in zip(rows["block"], words, rows["sizes"], contexts, strict=True):
        out.append({"kind": "asked", "block": int(block), "shard": shard, "words": squeeze(of_word[w : w + len(own)], "<u4", True), "sizes": size, "contexts": squeeze(of_context[x : x + len(context)], "<u4")})
        w, x = w + len(own), x + len(context)
    del words, sizes, contexts, of_word, of_context, count, pair, at
    trim()
    return pd.DataFrame(out).reindex(columns=_names(DEALT))


class Level:
    """What all shards share of one state: the sums of the parent restaurant, and the discounts."""

    def __init__(self, scalars, fixed: tuple[float, float] | None = None):
        self.top_customers, self.top_tables, self.words, self.tokens, n1, n2, m1, m2 = map(float, scalars)
        self.discount, self.top_discount = fixed or (min(0.95, max(0.05, n1 / max(1.0, n1 + 2 * n2))), min(0.95, max(0.05, m1 / max(1.0, m1 + 2 * m2))))
        self.strength = 1.0

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Predictive probabilities of known words in the word restaurant."""
        return (customers - self.top_discount * tables + (self.strength + self.top_discount * self.top_tables) / (self.words + 1)) / (self.strength + self.top_customers)

    @property
    def unknown(self) -> float:
        """That of a word which is not known."""
        return float((self.strength + self.top_discount * self.top_tables) / (self.words + 1) / (self.strength + self.top_customers))

    def back_off(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """What context restaurants of so many customers and tables give to their parent's probability."""
        return (self.strength + self.discount * tables) / (self.strength + customers)


def _arrays(r, shared: pd.DataFrame) -> tuple:
    """word, context (its place in ctx), c, t, top, seen; customers and tables of ctx in all shards."""
    size = open_up(r["sizes"], "<u4").astype(np.int64)
    at = open_up(r["contexts"], "<u4").astype(np.int64)
    shared = shared.sort_values("bucket")
    n, t = (np.concatenate([open_up(x, "<u8") for x in shared[k]]).astype(np.float64) if len(shared) else np.zeros(0) for k in ("n", "t"))
    c, tables, top = (open_up(r[k], "<u4").astype(np.int64) for k in ("counts", "tables", "top_tables"))
    return np.repeat(np.arange(len(size)), size), at, c, tables.astype(np.float64), top.astype(np.float64), open_up(r["seen"], "<u8").astype(np.float64), n, t


def predictive(level: Level, word, at, c, t, top, n, tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of each pair, of each word in the parent, what each context gives to the parent's)."""
    p0 = level.parent(np.bincount(word, t, len(top)) if len(top) else np.zeros(0), top)
    back = level.back_off(n, tables)
    return (c - level.discount * t) / (level.strength + n[at]) + back[at] * p0[word], p0, back


def shared_totals(state: DataFrame, buckets: int) -> DataFrame:
    """SHARED rows: for each shard and range of contexts the customers and tables that its contexts have in all shards."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, ctx, n, t in zip(b["shard"], b["ctx"], b["ctx_n"], b["ctx_t"], strict=True):
                ctx, n, t = open_up(ctx, "<u8", True), open_up(n, "<u4"), open_up(t, "<u4")
                cut = np.searchsorted(ctx, np.array([-(-(k << BITS) // buckets) for k in range(buckets + 1)], np.uint64))
                rows = [(k, shard, squeeze(ctx[x:y], "<u8", True), squeeze(n[x:y], "<u4"), squeeze(t[x:y], "<u4")) for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
                yield pd.DataFrame(rows, columns=["bucket", "shard", "ctx", "n", "t"])

    def total(key, rows: pd.DataFrame) -> pd.DataFrame:
        lists = [open_up(x, "<u8", True) for x in rows["ctx"]]
        names, place = np.unique(np.concatenate(lists), return_inverse=True)
        n, t = (np.bincount(place, np.concatenate([open_up(x, "<u4") for x in rows[k]]), len(names)) for k in ("n", "t"))
        ends = np.cumsum([len(x) for x in lists])
        out = [(int(s), int(key[0]), squeeze(n[place[e - len(x) : e]], "<u8"), squeeze(t[place[e - len(x) : e]], "<u8")) for s, x, e in zip(rows["shard"], lists, ends, strict=True)]
        trim()
        return pd.DataFrame(out, columns=["shard", "bucket", "n", "t"])

    parts = state.select("shard", "ctx", "ctx_n", "ctx_t").mapInPandas(split, "bucket int, shard int, ctx binary, n binary, t binary")
    return parts.groupBy("bucket").applyInPandas(total, SHARED)


def _sweep(level: Level, seed: int, keep: bool):
    def run(key, state: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        r = state.iloc[0]
        word, at, c, t, top, seen, n, tables = _arrays(r, shared)
        rng = np.random.default_rng([seed, int(r["shard"])])
        pair_p, p0, back = predictive(level, word, at, c, t, top, n, tables)
        kept = {}
        if keep:
            kept = {"kept": _f((np.frombuffer(r["kept"], "<f4") if r["kept"] else 0) + pair_p), "kept_top": r["kept_top"] + _f(p0), "kept_back": r["kept_back"] + _f(back)}
        t = seat(c, (level.strength + level.discount * np.maximum(tables[at] - t, 0)) * p0[word], level.discount, rng)
        customers = np.bincount(word, t, len(top)) if len(top) else np.zeros(0)
        top = seat(customers.astype(np.int64), (level.strength + level.top_discount * np.maximum(level.top_tables - top, 0)) / (level.words + 1), level.top_discount, rng)
        out = pd.DataFrame([dict(r) | {"tables": squeeze(t, "<u4"), "top_tables": squeeze(top, "<u4"), **kept, **_sums(at, len(n), c, t, top, customers, seen)}])
        trim()
        return out

    return run


def _finish(level: Level, samples: int):
    """The averages of the kept sweeps and the last state."""

    def run(key, state: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        r = state.iloc[0]
        word, at, c, t, top, _, n, tables = _arrays(r, shared)
        p, p0, back = predictive(level, word, at, c, t, top, n, tables)
        p = (p + (np.frombuffer(r["kept"], "<f4") if r["kept"] else 0)) / samples
        out = dict(r[["shard", "seen", "sizes", "contexts"]]) | {"p": squeeze(p, "<f4"), "tops": r["kept_top"] + _f(p0), "backs": r["kept_back"] + _f(back)}
        trim()
        return pd.DataFrame([out])[_names(DONE)]

    return run


def _answer(samples: int):
    """For each block's question to a shard: counts of words, and log10 probabilities of its pairs."""

    def run(key, asked: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        r, rows = state.iloc[0], []
        size_of, seen = open_up(r["sizes"], "<u4").astype(np.int64), open_up(r["seen"], "<u8")
        pairs = np.repeat(np.arange(len(size_of)), size_of) << 32 | open_up(r["contexts"], "<u4").astype(np.int64)
        p = open_up(r["p"], "<f4")
        tops, backs = (np.frombuffer(r[k], "<f4").reshape(samples, -1) for k in ("tops", "backs"))
        for _, q in asked.iterrows():
            words, size = open_up(q["words"], "<u4", True).astype(np.int64), open_up(q["sizes"], "<u4").astype(np.int64)
            context, word = open_up(q["contexts"], "<u4").astype(np.int64), np.repeat(words, size)
            prob = (backs[:, context] * tops[:, word]).mean(0)
            if len(pairs):
                want = word << 32 | context
                found = np.minimum(np.searchsorted(pairs, want), len(pairs) - 1)
                prob = np.where(pairs[found] == want, p[found], prob)
            rows.append((int(q["block"]), int(key[0]), squeeze(seen[words], "<u8"), squeeze(np.log10(prob), "<f4")))
        trim()
        return pd.DataFrame(rows, columns=["block", "shard", "seen", "logs"])

    return run


def _score(tokens: float, words: float):
    def run(key, text: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        held = unpack_texts(zstandard.ZstdDecompressor().decompress(text["words"].iloc[0]))
        c = Counted([x[3] for x in held])
        _, place = c.pairs()
        answers = answers.sort_values("shard")
        seen = np.concatenate([open_up(x, "<u8") for x in answers["seen"]]).astype(np.float64)
        logs = np.concatenate([open_up(x, "<f4") for x in answers["logs"]]).astype(np.float64)
        n = seen[c.rank[c.tokens]]
        base = np.log10((n + 0.5) / (tokens + 0.5 * (words + 1)))
        begin = np.cumsum(c.sizes) - c.sizes
        out = pd.DataFrame({"n_tokens": c.sizes, "n_known": np.add.reduceat((n > 0).astype(np.int64), begin), "base_score": np.add.reduceat(base, begin), "score": np.add.reduceat(logs[place], begin)})
        out["held_out"] = [bool(x[2]) for x in held]
        out["train_tokens"] = int(tokens)
        out["key"] = pd.Series([x[1] for x in held], dtype=object)
        del held, c, place, seen, logs, n, base
        trim()
        return out[["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]]

    return run


def score_documents(docs: DataFrame, held_out: Column, sweeps: int = 4, samples: int = 2, block_bytes: int = 6 << 20, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of each text; learns where held_out is false."""
    spark: SparkSession = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    shards = max(8, -(-total_bytes(docs, text_col) // block_bytes))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), to_worker(id_col).alias("key"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    # a group for each shard and for each block's texts: one exchange, and one table of texts, questions and states
    blocks = _blocks(rows, block_bytes, shards).withColumn("group", F.when(F.col("shard") < 0, -1 - F.col("block")).otherwise(F.col("shard").cast("long")))
    dealt = materialise(spark, blocks.groupBy("group").applyInPandas(_begin, DEALT), "dealt", by=["kind"])
    release(spark)
    state = dealt.filter("kind = 'state'").select(*_names(STATE))
    buckets = max(4, shards // 8)
    level = Level(_scalars_of(state))
    fixed, kept = (level.discount, level.top_discount), 0

    def with_totals(df: DataFrame, f, schema: str) -> DataFrame:
        return df.groupBy("shard").cogroup(shared_totals(df, buckets).groupBy("shard")).applyInPandas(f, schema)

    for i in range(sweeps):
        keep = i > sweeps - samples  # the seats before this sweep are those of sweep i - 1; the last sweep's are used as they are
        kept += keep
        old, state = state, materialise(spark, with_totals(state, _sweep(level, seed + i, keep), STATE), "seats")
        if i:
            discard(old)
        else:
            remove(spark, f"{dealt.written_at}/kind=state")
        release(spark)
        level = Level(_scalars_of(state), fixed)
    done = materialise(spark, with_totals(state, _finish(level, kept + 1), DONE), "probabilities")
    if sweeps:
        discard(state)
    release(spark)
    questions = dealt.filter("kind = 'asked'").select(*_names(ASKED))
    answers = materialise(spark, questions.groupBy("shard").cogroup(done.groupBy("shard")).applyInPandas(_answer(kept + 1), "block long, shard int, seen binary, logs binary"), "answers")
    discard(done)
    release(spark)
    texts = dealt.filter("kind = 'text'").select("block", "words")
    out = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_score(level.tokens, level.words), "key string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select(from_worker("key", kind).alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, tokens, perplexity, base_perplexity of scored documents."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))


def _scalars_of(state: DataFrame) -> list[float]:
    """The shards' eight sums, added up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(np.array([np.frombuffer(x, "<f8") for x in b["scalars"]]).reshape(-1, 8).sum(0)[None], columns=[f"s{i}" for i in range(8)])

    row = state.select("scalars").mapInPandas(run, ", ".join(f"s{i} double" for i in range(8))).agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)) for i in range(8)]).first()
    return list(row)
