"""Words against a deletion index inside a worker (J6, J7): which words of a language are the word itself or it without one sign.

The index (lang, variant, word) is bounded by the lexicons' length, so it travels to every worker as arrays: sorted 64-bit
digests of the variants, a bit map of them that refuses most nonsense words at once, and the variants' own signs, which every
hit is compared with. Languages are bits of a number, so an index of more than 60 of them does not go this way. The digest of a word without its i-th sign comes from sums over the word's beginning and end.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa

_STEP, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
#: Words whose answers a worker remembers.
REMEMBERED = 100_000
_ANSWERS: dict[str, dict[str, tuple]] = {}
_MASKS: dict[str, dict[str, int]] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    return np.array([pow(_STEP, j, 2**64) for j in range(n)], np.uint64)


def _by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


def _codes(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n).astype(np.uint64) + np.uint64(1)


def digests(words: list[str]) -> np.ndarray:
    """The digests of whole words."""
    out = np.zeros(len(words), np.uint64)
    for n, at in _by_length(words).items():
        if n:
            out[at] = _mixed((_codes([words[i] for i in at], n) * _powers(n)).sum(1, dtype=np.uint64))
    return out


@dataclass
class Index:
    name: str
    langs: list[str]
    known: np.ndarray  # digests in order
    bits: np.ndarray
    mask: int
    lang: np.ndarray
    word: np.ndarray
    variants: bytes
    variant_at: np.ndarray
    words: bytes
    word_at: np.ndarray

    @classmethod
    def of(cls, name: str, rows: pa.Table) -> Index:
        """rows: lang, variant, word."""
        rows = rows.combine_chunks()
        variants = rows.column("variant").to_pylist()
        h = digests(variants)
        order = np.argsort(h, kind="stable")
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        words = rows.column("word").combine_chunks().dictionary_encode()
        size = max(16, (len(h) * 24).bit_length())
        bits = np.zeros(1 << (size - 3), np.uint8)
        mask = (1 << size) - 1
        place = h & np.uint64(mask)
        np.bitwise_or.at(bits, (place >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (place & np.uint64(7)).astype(np.uint8)))
        encode = lambda texts: [x.encode("utf-8", "surrogatepass") for x in texts]
        cut = lambda texts: np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        ordered, names = encode([variants[i] for i in order]), encode(words.dictionary.to_pylist())
        out = cls(
            name, langs.dictionary.to_pylist(), h[order], bits, mask, langs.indices.to_numpy()[order].astype(np.int32), words.indices.to_numpy()[order].astype(np.int32),
            b"".join(ordered), cut(ordered), b"".join(names), cut(names),
        )
        out.prepared()
        return out

    def _tried(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(word, nth, row) in order: nth is 0 for the whole word and i for it without its i-th sign; digests agree."""
        out = []
        for n, at in _by_length(words).items():
            if not n:
                continue
            h = self._digests((_codes([words[i] for i in at], n) - np.uint64(1)).astype(np.uint32))
            place = h & np.uint64(self.mask)
            some = (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
            i, nth = np.nonzero(some)
            x = h[i, nth]
            low, high = np.searchsorted(self.known, x, "left"), np.searchsorted(self.known, x, "right")
            hit = np.flatnonzero(high > low)
            for k, j, a, b in zip(i[hit].tolist(), nth[hit].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
                out += [(at[k], j, row) for row in range(a, b)]
        return out

    def matches(self, words: list[str]) -> list[tuple[tuple[int, str], ...]]:
        """For each word (in basic letters) its matches: a pair of the language's place and the word for each language that has one."""
        first: list[dict[int, str]] = [{} for _ in words]
        for i, nth, row in self._tried(words):  # of one word in the order of nth
            lang = int(self.lang[row])
            if lang in first[i]:
                continue
            w = words[i]
            v = w if not nth else w[: nth - 1] + w[nth:]
            if self.variants[self.variant_at[row] : self.variant_at[row + 1]] == v.encode("utf-8", "surrogatepass"):
                k = int(self.word[row])
                first[i][lang] = self.words[self.word_at[k] : self.word_at[k + 1]].decode("utf-8", "surrogatepass")
        return [tuple(sorted(x.items())) for x in first]

    def prepared(self) -> None:
        """For ``masks``: each variant once, with its languages as bits, its signs and the place of its digest's first bits."""
        edge = np.flatnonzero(np.concatenate([[True], self.known[1:] != self.known[:-1]])) if len(self.known) else np.zeros(0, np.int64)
        self.unique = self.known[edge]
        texts = [self.variants[self.variant_at[i] : self.variant_at[i + 1]] for i in range(len(self.known))]
        group = np.cumsum(np.bincount(edge, minlength=len(self.known))) - 1 if len(edge) else edge
        for i in range(1, len(texts)):
            if group[i] == group[i - 1] and texts[i] != texts[i - 1]:
                raise ValueError("two variants have one digest")
        self.of_langs = np.bitwise_or.reduceat(np.uint64(1) << self.lang.astype(np.uint64), edge) if len(edge) else np.zeros(0, np.uint64)
        signs = [texts[i].decode("utf-8", "surrogatepass") for i in edge]
        self.signs = np.frombuffer("".join(signs).encode("utf-32-le", "surrogatepass") + b"\0" * 4, "<u4")
        self.size = np.array([len(x) for x in signs], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.shift = np.uint64(64 - 20)
        self.bucket = np.searchsorted(self.unique, np.arange(1 << 20, dtype=np.uint64) << self.shift).astype(np.int32)

    def _place(self, x: np.ndarray) -> np.ndarray:
        """The places of digests among ``unique``, -1 where they are not; buckets have one member in the mean."""
        at = self.bucket[(x >> self.shift).astype(np.int64)].astype(np.int64)
        out, left = np.full(len(x), -1, np.int64), np.arange(len(x))
        while len(left):
            at, left = at[at < len(self.unique)], left[at < len(self.unique)]
            here = self.unique[at]
            same = here == x[left]
            out[left[same]] = at[same]
            more = here < x[left]
            at, left = at[more] + 1, left[more]
        return out

    def masks(self, words: list[str], plain) -> np.ndarray:
        """For each word the languages, as bits, in which it has a match; ``plain`` makes basic letters of lines."""
        out = np.zeros(len(words), np.uint64)
        if not words:
            return out
        text = "\n".join(words)
        everything = np.frombuffer(((text.lower() if text.isascii() else plain(text)) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.flatnonzero(everything == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        lengths = ends - starts
        for n in np.unique(lengths[lengths > 0]).tolist():
            rows = np.flatnonzero(lengths == n)
            signs = everything[starts[rows][:, None] + np.arange(n)]
            h = self._digests(signs)
            place = h & np.uint64(self.mask)
            some = (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
            i, nth = np.nonzero(some)
            at = self._place(h[i, nth])
            keep = at >= 0
            i, nth, at = i[keep], nth[keep], at[keep]
            keep = self.size[at] == n - (nth > 0)
            i, nth, at = i[keep], nth[keep], at[keep]
            width = np.arange(n)
            skip = np.where(nth == 0, n, nth - 1)[:, None]
            source = width + (width >= skip)
            inside = width < self.size[at][:, None]
            mine = signs[i[:, None], np.minimum(source, n - 1)]
            theirs = self.signs[np.minimum(self.start[at][:, None] + width, len(self.signs) - 1)]
            right = ((mine == theirs) | ~inside).all(1)
            found = np.zeros(h.shape, np.uint64)
            found[i[right], nth[right]] = self.of_langs[at[right]]
            out[rows] = np.bitwise_or.reduce(found, axis=1)
        return out

    def _digests(self, signs: np.ndarray) -> np.ndarray:
        """Digests of words of one length and of them without their i-th sign."""
        n = signs.shape[1]
        c, p = signs.astype(np.uint64) + np.uint64(1), _powers(n)
        up = np.cumsum(c * p, axis=1, dtype=np.uint64)
        h = np.zeros((len(c), n + 1), np.uint64)
        h[:, 0] = up[:, -1]
        if n > 1:
            h[:, 1:-1] = np.cumsum((c[:, 1:] * p[:-1])[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
            h[:, 2:] += up[:, :-1]
        return _mixed(h) if n > 1 else _mixed(h[:, :1])

    def counted(self, real: list[set[str]], nonsense: list[set[str]], plain) -> list[tuple[np.ndarray, np.ndarray, list[list[str]]]]:
        """For each document the matches of its words and of nonsense by language, and ten examples "word~match" for each language."""
        k = len(self.langs)
        have = _MASKS.setdefault(self.name, {})
        if len(_MASKS) > 4:
            _MASKS.clear()
            _MASKS[self.name] = have
        new = list({w for x in real for w in x if w not in have})
        if len(have) + len(new) > REMEMBERED:
            have.clear()
            new = list(set().union(*real))
        have.update(zip(new, self.masks(new, plain).tolist(), strict=True))
        lists = [list(x) for x in real]
        masks = [[have[w] for w in x] for x in lists]
        sizes = [[len(x) for x in side] for side in (real, nonsense)]
        tables = []
        for flat, size in zip((np.array([m for x in masks for m in x], np.uint64), self.masks([w for x in nonsense for w in x], plain)), sizes, strict=True):
            of = np.repeat(np.arange(len(size)), size)
            tables.append(np.stack([np.bincount(of[((flat >> np.uint64(i)) & np.uint64(1)).astype(bool)], minlength=len(size)) for i in range(k)], 1) if k else np.zeros((len(size), 0), np.int64))
        chosen = []
        for words, mask in zip(lists, masks, strict=True):
            some = [w for w, m in zip(words, mask, strict=True) if m]
            special = any("~" in w for w in some)  # else the order is that of the words with the mark behind them
            order = some if special else [w[:-1] for w in sorted([w + "~" for w in some])]
            chosen.append([list(islice((w for w in order if have[w] >> i & 1), None if special else 10)) for i in range(k)])
        known = self.answers({w for x in chosen for ws in x for w in ws}, plain)
        examples = [[sorted(f"{w}~{dict(known[w])[i]}" for w in ws)[:10] for i, ws in enumerate(x)] for x in chosen]
        return list(zip(tables[0], tables[1], examples, strict=True))

    def answers(self, words: set[str], plain) -> dict[str, tuple]:
        """The matches of words as they stand, of which ``plain`` makes basic letters; remembered while there is room."""
        have = _ANSWERS.setdefault(self.name, {})
        if len(_ANSWERS) > 4:
            _ANSWERS.clear()
            _ANSWERS[self.name] = have
        new = [w for w in words if w not in have]
        if len(have) + len(new) > REMEMBERED:
            have.clear()
            new = list(words)
        have.update(zip(new, self.matches([plain(w) for w in new]), strict=True))
        return have
