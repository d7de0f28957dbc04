"""Packing by lexical retrieval: windows of a seed document and its nearest unused neighbours.

The index is sharded by content: a document's route is the least hash of its words of six bytes or more, so documents
that share words meet, wherever in the input they stand, with a probability of the similarity of their word sets.
One exchange deals documents by route (a rebalancing one, so that Spark splits the partition of a hot route), a partition is
sorted by route, and each ``shard_bytes`` of text in that order make a shard with an inverted index of its whole
texts (words; BM25 weights, which are positive for every word; the weights of words of many documents are kept as whole
rows). The next unused document seeds a window; its best unused neighbours by BM25 follow, then unused documents in
order of route, until the window is full. The document that crosses the end is cut there and its rest seeds the
next window, so only a shard's last window is short. The order inside a partition is total, so a task that
is repeated after a loss packs alike.

Tokenising works on runs of text between spaces and line feeds, remembered by each worker: the vocabulary's normaliser and
pre-tokeniser split at white space, so the ids of a text are the ids of its parts.

Defined results: null text counts as empty; an empty text is its end id alone; repeated rows are packed
once each; an empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import from_worker, to_worker, trim

REMEMBERED, LONGEST = 100_000, 64
#: Words that a chunk of a shard has when its ids are written out.
CHUNK = 1 << 16
MARKS = frozenset(".,;:!?")
K1, B = 1.2, 0.75
#: The weights of words of a larger share of a shard's documents are kept as rows of all documents; results do not depend on it.
COMMON = 0.25
#: Fixed value: the vocabulary's own pre-tokeniser pattern.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as the characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Numbers words (parts of texts between spaces and line feeds) and knows the ids of each.

    Words of Latin letters are cut by the vocabulary's own pre-tokeniser pattern and their parts encoded by ranks of byte
    strings, where byte 255 (in no UTF-8 text) stands for the end of a word; other words go through the tokenizers
    library whole. Loading checks both ways against each other on every string of the vocabulary.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        probe = "Ab  c's\n\nd e\t f"
        if self._whole(probe) != [i for w in probe.replace("\n", " ").split(" ") for i in self._whole(w)]:
            raise ValueError("this vocabulary's ids depend on white space; texts cannot be encoded by words")
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        byte, ranks = _byte_of_char(), {}
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            last = token.endswith("</w>") and len(token) > 4
            if token not in special:
                ranks[bytes(byte[c] for c in (token[:-4] if last else token)) + (b"\xff" if last else b"")] = i
        self.piece = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        own = {r.rstrip(b"\xff").decode("utf-8", "replace") for r in ranks}
        own = [w for w in own if w.isascii() and w == w.lower() and PARTS.findall(w) == [w]]
        if [e.ids for e in self.library.encode_batch(own, add_special_tokens=False)] != [self.piece(w.encode() + b"\xff") for w in own]:
            raise ValueError("this vocabulary's merges are not an order of ranks")
        self.clear()

    def _whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids, self.size, self.first, self.parts = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), {}
        self.held = 0  # characters of words

    def _part(self, p: str) -> list[int]:
        x = self.piece(p.encode() + b"\xff")
        if len(p) <= LONGEST:
            self.parts[p] = x
        return x

    def learn(self) -> None:
        """Find the ids of the words that were numbered since the last call."""
        get, part, marks = self.parts.get, self._part, {m: self.piece(m.encode() + b"\xff") for m in MARKS}
        new, fresh = [], list(islice(self.number, len(self.size), None))
        for w in fresh:
            low = w.lower()
            mark = marks.get(low[-1])
            bare = low[:-1] if mark else low
            if bare.isalpha() and (bare.isascii() or max(w) < "ɐ"):  # one part, or two with a mark behind it
                ids = get(bare) or part(bare)
                new.append(ids + mark if mark else ids)
                continue
            if w < "ɐ" and (w.isascii() or max(w) < "ɐ") and "<|" not in w:
                ids = []
                for p in PARTS.findall(low):
                    ids += get(p) or part(p)
            else:
                ids = self._whole(w)
            new.append(ids)
        self.held += sum(map(len, fresh))
        self.size = np.concatenate([self.size, np.fromiter(map(len, new), np.int64, len(new))])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(new), "<u4")])
        self.first = np.cumsum(self.size) - self.size
        if len(self.parts) > REMEMBERED:
            self.parts.clear()

    def texts(self, words: np.ndarray) -> np.ndarray:
        """The ids of consecutive words."""
        n = self.size[words]
        at = np.repeat(self.first[words] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return self.ids[at]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


class InvertedIndex:
    """BM25 postings of a shard's documents, given as arrays of term ids."""

    def __init__(self, docs: list[np.ndarray], common: float = COMMON):
        n = len(docs)
        sizes = np.array([len(d) for d in docs], np.int64)
        terms = np.concatenate(docs) if n else np.zeros(0, np.int64)
        pairs, tf = np.unique(terms.astype(np.int64) * n + np.repeat(np.arange(n), sizes), return_counts=True)
        term, doc = pairs // max(n, 1), pairs % max(n, 1)
        change = np.diff(term, prepend=-1) != 0
        df = np.bincount(np.cumsum(change) - 1) if len(term) else np.zeros(0, np.int64)
        idf = np.where(df > 1, np.log1p((n - df + 0.5) / (df + 0.5)), 0.0)  # a word of one document finds no neighbour
        weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / max(sizes.mean(), 1e-9))) if n else np.zeros(0)
        wide = (df > 1) & (df > common * n)
        row = np.repeat(np.where(wide, np.cumsum(wide) - 1, -1), df)
        self.rows, self.column = np.zeros((int(wide.sum()), n), np.float32), np.arange(n)
        self.rows[row[row >= 0], doc[row >= 0]] = weight[row >= 0]
        self.wide = np.ascontiguousarray(self.rows.T > 0)
        keep = np.repeat((idf > 0) & ~wide, df)
        doc, weight = doc[keep], weight[keep]
        self.doc, self.weight = doc.astype(np.int32), weight.astype(np.float32)
        term = np.cumsum(change[keep]) - 1  # words that are left, numbered anew
        self.begin = np.searchsorted(term, np.arange(int(term[-1]) + 2 if len(term) else 1))
        order = np.argsort(self.doc, kind="stable")
        self.terms, self.term_begin = term[order], np.searchsorted(self.doc[order], np.arange(n + 1))
        self.n, self.term_of, self.alive = n, term, n

    def forget(self, unused: np.ndarray) -> None:
        """Drop the postings of used documents once a fifth of the documents that have some are used."""
        alive = int(np.count_nonzero(unused))
        if alive <= 0.8 * self.alive:
            keep = unused[self.doc]
            self.doc, self.weight, self.term_of = self.doc[keep], self.weight[keep], self.term_of[keep]
            self.begin, self.alive = np.searchsorted(self.term_of, np.arange(len(self.begin))), alive
            self.rows, self.column = self.rows[:, unused[self.column]], self.column[unused[self.column]]

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share a weighted word with the seed, best first; of equal scores the first document."""
        words = self.terms[self.term_begin[seed] : self.term_begin[seed + 1]]
        lo, hi = self.begin[words], self.begin[words + 1]
        size = hi - lo
        rows = np.flatnonzero(self.wide[seed])
        if not size.sum() and not len(rows):
            return
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        score = np.bincount(self.doc[at], self.weight[at], minlength=self.n).astype(np.float64)  # whole numbers if nothing is counted
        score[self.column] += self.rows[rows].sum(axis=0, dtype=np.float64)
        score[~unused] = 0
        done = 0
        for top in (32, 256, self.n):
            found = np.flatnonzero(score)
            if len(found) > top:
                edge = np.partition(score[found], len(found) - top)[len(found) - top]
                found = found[score[found] >= edge]
            ranked = found[np.lexsort((found, -score[found]))]
            yield from ranked[done:]
            done = len(ranked)
            if len(ranked) == np.count_nonzero(score):
                return


def pack(sizes: np.ndarray, terms: list[np.ndarray], window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; sequences are full but for the last."""
    index, n = InvertedIndex(terms), len(sizes)
    unused, rest = np.ones(n, bool), np.zeros(n, np.int64)  # rest: where the unpacked part begins
    out, seq, room, following = [], 0, window, 0

    def place(d: int) -> bool:
        """Put what is left of d, as far as the window has room; whether the window is full."""
        nonlocal room
        take = min(room, int(sizes[d]) - int(rest[d]))
        out.append((d, int(rest[d]), take, seq, window - room))
        rest[d] += take
        room -= take
        unused[d] = rest[d] < sizes[d]
        return room == 0

    seed = 0
    while seed < n:
        full = place(seed)
        last = seed
        if not full:
            index.forget(unused)
            for d in index.neighbours(seed, unused):
                last, full = d, place(d)
                if full:
                    break
        while not full:
            while following < n and not unused[following]:
                following += 1
            if following == n:
                break
            last, full = following, place(following)
        seq, room = seq + 1, window
        while following < n and not unused[following]:
            following += 1
        seed = last if unused[last] else following
    return out


def checksums(known: Vocabulary, words: list[np.ndarray], end_id: int, pieces: list[tuple]) -> list[int]:
    """crc32 of the ids of each piece; ids are written out for a chunk of documents at a time."""
    out, nth = [0] * len(pieces), 0
    order = sorted(range(len(pieces)), key=lambda i: pieces[i][0])
    end, begin = np.array([end_id], "<u4"), 0
    while begin < len(words):
        stop, held = begin, 0
        while stop < len(words) and (stop == begin or held + len(words[stop]) <= CHUNK):
            held += len(words[stop])
            stop += 1
        flat = known.texts(np.concatenate(words[begin:stop]))
        at = 0
        for d in range(begin, stop):
            n = int(known.size[words[d]].sum())
            raw = memoryview(np.concatenate([flat[at : at + n], end]).astype("<u4", copy=False)).cast("B")
            at += n
            while nth < len(order) and pieces[order[nth]][0] == d:
                _, start, length, _, _ = pieces[order[nth]]
                out[order[nth]] = zlib.crc32(raw[4 * start : 4 * (start + length)])
                nth += 1
        begin = stop
    return out


def routed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, content, dealt by the least hash of the content's long words and sorted by it in each partition."""
    d = docs.select(to_worker(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    least = F.array_min(F.transform(F.split("content", " "), lambda w: F.when(F.octet_length(w) >= 6, F.xxhash64(w))))
    d = d.withColumn("route", F.coalesce(least, F.xxhash64("content")))
    return d.hint("rebalance", "route").sortWithinPartitions("route", F.xxhash64("content"), "key").select("key", "content")


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, shard_bytes: int = 6 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece; an exchange of the texts and one of the result's few rows."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary(tokenizer_path)
        base, done = TaskContext.get().partitionId() << 36, 0
        keys: list = []
        words: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal done, held
            known.learn()
            n = np.array([int(known.size[w].sum()) for w in words]) + 1
            pieces = pack(n, words, window)
            sums = checksums(known, words, end_id, pieces)
            rows = [(keys[d], s, k, c, n[d], base + done + q, o) for (d, s, k, q, o), c in zip(pieces, sums, strict=True)]
            done += 1 + max((q for *_, q, _ in pieces), default=-1)
            keys.clear(), words.clear()
            if len(known.number) > REMEMBERED or known.held > REMEMBERED * 16:
                known.clear()
            held = 0
            for i in range(0, len(rows), 20_000):
                yield pd.DataFrame(rows[i : i + 20_000], columns=names)
            trim()

        for b in batches:
            for key, text in zip(b["key"], b["content"], strict=True):
                keys.append(key)
                words.append(np.fromiter(map(known.number.__getitem__, filter(None, text.replace("\n", " ").split(" "))), np.int32))
                held += len(text) + 64
                if held >= shard_bytes:
                    yield from flush()
        if keys:
            yield from flush()
    out = routed(docs, id_col, text_col).mapInPandas(run, "key string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    out = out.select(from_worker("key", kind).alias(id_col), *names[1:])
    return out.hint("rebalance", "sequence_id")  # a shard has few rows; else each would be a file
