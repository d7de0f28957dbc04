"""SentencePiece text with a unigram model: Viterbi over a double-array trie, byte fallback, decoding.

A model is the pieces and scores of a SentencePiece model file. A text gets the marked form (a white-space
mark before it and for each space); the best path has the largest sum of scores, where a character that no
piece covers costs the unknown score (the least score less 10) and is written as byte pieces. Of equal paths
the one whose last piece is longest wins, at each end. Decoding joins pieces, turns byte pieces to bytes and
marks to spaces and drops the first one.

Texts are cut before each run of marks and around each character that occurs in no piece; no piece crosses
such a place (checked at loading), so the best path of a text is the best paths of its parts, one after another, and the paths
of parts are remembered by each worker.

Defined results: null counts as empty; the empty text has no pieces; texts that hold the mark itself decode
to spaces in its place (the format cannot tell them apart); repeated rows code alike.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import from_worker, to_worker

MARK = "▁"
REMEMBERED, LONGEST = 800_000, 64


def _fields(raw: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(field, wire type, value) of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            b = raw[i]
            n |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return n, i

    i = 0
    while i < len(raw):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = raw[i : i + size], i + size
        yield key >> 3, kind, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id; types: 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte."""
    out = []
    with open(path, "rb") as f:
        for field, _, value in _fields(f.read()):
            if field == 1:
                got = {k: v for k, _, v in _fields(value)}
                out.append((got[1].decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, 1)))
    return out


class DoubleArray:
    """A double-array trie over byte strings: the child of state s by byte b is t = base[s] + b + 1 where check[t] == s."""

    def __init__(self, words: dict[bytes, int]):
        tree: list[dict[int, int]] = [{}]
        value: list[int] = [-1]
        for word, v in words.items():
            s = 0
            for b in word:
                t = tree[s].get(b)
                if t is None:
                    t = tree[s][b] = len(tree)
                    tree.append({})
                    value.append(-1)
                s = t
            value[s] = v
        size = 2 * len(tree) + 600
        base, check, out = [0] * size, [-1] * size, [-1] * size
        used = bytearray(size)
        used[0] = 1
        at, queue, first = {0: 0}, [0], 1
        for node in queue:  # grows while it is walked
            s = at[node]
            out[s] = value[node]
            kids = sorted(tree[node])
            if not kids:
                continue
            p, seen, full = max(first, kids[0] + 1), 0, 0
            while True:
                if p + 300 > len(used):
                    grow = len(used)
                    base += [0] * grow
                    check += [-1] * grow
                    out += [-1] * grow
                    used += bytearray(grow)
                b = p - kids[0] - 1
                if not used[p] and not any(used[b + k + 1] for k in kids):
                    break
                seen, full, p = seen + 1, full + used[p], p + 1
            if seen > 50 and full > 0.9 * seen:
                first = p  # what lies before is nearly full; later searches begin here
            base[s] = b
            for k in kids:
                t = b + k + 1
                used[t], check[t], at[tree[node][k]] = 1, s, t
                queue.append(tree[node][k])
        self.base, self.check, self.value = base, check, out

    def prefixes(self, raw: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(end, value) of each word that raw has at start."""
        base, check, value = self.base, self.check, self.value
        s = 0
        for i in range(start, len(raw)):
            t = base[s] + raw[i] + 1
            if t >= len(check) or check[t] != s:
                return
            s = t
            if value[s] >= 0:
                yield i + 1, value[s]


class UnigramModel:
    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.pieces = pieces
        normal = {p.encode(): i for i, (p, _, kind) in enumerate(pieces) if kind in (1, 4) and p}
        self.scores = [s for _, s, _ in pieces]
        self.unknown = min((self.scores[i] for i in normal.values()), default=0.0) - 10.0
        self.byte_ids = [0] * 256
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 6:
                self.byte_ids[int(p[3:5], 16)] = i
        self.unknown_id = next((i for i, x in enumerate(pieces) if x[2] == 2), 0)
        self.has_bytes = sum(kind == 6 for _, _, kind in pieces) == 256
        self.trie = DoubleArray(normal)
        self.surface = [bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind == 3 else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.is_byte = [kind == 6 for _, _, kind in pieces]
        texts = [p.decode() for p in normal]
        self.cuts = [r"▁*[^▁\n]+|▁+|\n+", r"▁*[^▁]+|▁+"]["\n" in "".join(texts)] if not any(MARK in p.lstrip(MARK) for p in texts) else None
        self.paths: dict[str, tuple[int, ...]] = {}

    def viterbi(self, part: str) -> tuple[int, ...]:
        """Ids of the best path over one part of a marked text."""
        raw = part.encode("utf-8", "replace")
        n, low = len(raw), float("-inf")
        best, back, pieces = [low] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value, scores, unknown = self.trie.base, self.trie.check, self.trie.value, self.scores, self.unknown
        states, i = len(check), 0
        while i < n:
            first = raw[i]
            end = i + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)
            here, single, s = best[i], False, 0
            for j in range(i, n):  # the pieces that begin here
                t = base[s] + raw[j] + 1
                if t >= states or check[t] != s:
                    break
                s = t
                piece = value[s]
                if piece >= 0:
                    j += 1
                    total = here + scores[piece]
                    if total > best[j]:
                        best[j], back[j], pieces[j] = total, i, piece
                    if j == end:
                        single = True
            if not single and here + unknown > best[end]:
                best[end], back[end], pieces[end] = here + unknown, i, -1
            i = end
        ids: list[int] = []
        end = n
        while end:
            start, piece = back[end], pieces[end]
            if piece >= 0:
                ids.append(piece)
            elif self.has_bytes:
                ids.extend(self.byte_ids[b] for b in reversed(raw[start:end]))
            else:
                ids.append(self.unknown_id)
            end = start
        return tuple(reversed(ids))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if self.cuts is None:
            return list(self.viterbi(marked))
        parts = re.findall(self.cuts, marked)
        get = self.paths.get
        found = list(map(get, parts))
        if None in found:
            if len(self.paths) > REMEMBERED:
                self.paths.clear()
            for k, p in enumerate(parts):
                if found[k] is None:
                    found[k] = get(p) or self.viterbi(p)
                    if len(p) <= LONGEST:
                        self.paths[p] = found[k]
        return list(chain.from_iterable(found))

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_LOADED: dict[str, UnigramModel] = {}


def load(path: str) -> UnigramModel:
    if path not in _LOADED:
        _LOADED[path] = UnigramModel(read_pieces(path))
    return _LOADED[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece ids as an array, for each row; a narrow pass."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        code = load(model_path).encode
        return pd.Series([np.array(code(t), np.int32) for t in texts], dtype=object)

    return docs.select(F.col(id_col), ids(F.coalesce(F.col(text_col), F.lit(""))).alias("pieces"))


def decode(coded: DataFrame, model_path: str, column: str = "pieces") -> DataFrame:
    """coded with its array of ids turned to a text column."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        back = load(model_path).decode
        return pd.Series([back(x) for x in ids], dtype=object)

    return coded.withColumn("text", text(F.col(column))).drop(column)


def digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_pieces, n_byte_pieces, score, pieces_crc32 (little-endian 32-bit ids), round_trip for each row, in one pass."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(model_path)
        scores, is_byte = np.array(model.scores), np.array(model.is_byte)
        for b in batches:
            rows = []
            for key, t in zip(b["key"], b["content"], strict=True):
                ids = model.encode(t)
                a = np.array(ids, np.int64)
                used = is_byte[a]
                rows.append((key, len(ids), int(used.sum()), float(scores[a[~used]].sum()), zlib.crc32(a.astype("<u4").tobytes()), model.decode(ids) == t.replace(MARK, " ")))
            yield pd.DataFrame(rows, columns=["key", "n_pieces", "n_byte_pieces", "score", "pieces_crc32", "round_trip"])

    keyed = docs.select(to_worker(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    out = keyed.mapInPandas(run, "key string, n_pieces long, n_byte_pieces long, score double, pieces_crc32 long, round_trip boolean")
    return out.select(from_worker("key", kind).alias(id_col), "n_pieces", "n_byte_pieces", "score", "pieces_crc32", "round_trip")
