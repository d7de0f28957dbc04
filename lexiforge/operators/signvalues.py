"""Sign values against shuffles of the same values, for the words of one document at a time.

Trial i orders the values by md5 of trial, document and place; trial 0 is the mapping itself. The digests of all trials are
computed together. Words decode to numbers where all values are single signs, so that all trials of a document meet the
lexicon in one look-up; words that are too long for a number, and values of several signs, are decoded as texts.
"""

from __future__ import annotations

import hashlib
from math import fsum

import numpy as np

from lexiforge.operators.shuffle import BLOCK, md5_keys


class Trials:
    """The orders of n places in trials 1 to ``trials``, by md5 of "trial:document:place"."""

    def __init__(self, n: int, trials: int):
        self.n, self.trials = n, trials
        self.heads = [f"{t}:".encode() for t in range(1, trials + 1)]
        self.tails = [f":{i}".encode() for i in range(n)]
        self.blank: dict[int, np.ndarray] = {}

    def _messages(self, doc: bytes) -> np.ndarray:
        """Padded blocks of the messages, a row each; only the document's own signs are written anew."""
        k = len(doc)
        if k not in self.blank:
            rows = [h + b"\0" * k + t for h in self.heads for t in self.tails]
            self.blank[k] = np.frombuffer(b"".join((r + b"\x80").ljust(56, b"\0") + (8 * len(r)).to_bytes(8, "little") for r in rows), np.uint8).reshape(-1, 64)
        m = self.blank[k].copy()
        at = 0
        while at < self.trials:
            width = len(self.heads[at])
            end = min(self.trials, 10 ** (width - 1) - 1)
            m[at * self.n : end * self.n, width : width + k] = np.frombuffer(doc, np.uint8)
            at = end
        return m

    def orders(self, docs: list[str]) -> list[np.ndarray]:
        """For each document an array (trials + 1, n) of places; the first row is the order of the places themselves."""
        names = [d.encode("utf-8", "surrogatepass") for d in docs]
        longest = len(str(self.trials)) + 2 + len(str(self.n))
        out: list[np.ndarray] = []
        size = self.n * self.trials
        step = max(1, BLOCK // max(1, size))
        for i in range(0, len(names), step):
            part = names[i : i + step]
            short = [x for x in part if len(x) + longest <= 55]
            m = np.concatenate([self._messages(x) for x in short]) if short and size else np.zeros((0, 64), np.uint8)
            blocks = [md5_keys(m[a : a + 2 * BLOCK]) for a in range(0, len(m), 2 * BLOCK)]
            keys = iter((np.concatenate(blocks) if blocks else np.zeros(0, np.uint64)).reshape(len(short), self.trials, self.n))
            for x in part:
                key = next(keys) if len(x) + longest <= 55 else None
                order = np.argsort(key, axis=1) if key is not None else np.zeros((self.trials, self.n), np.int64)
                ranked = np.take_along_axis(key, order, 1) if key is not None else None
                doubtful = range(self.trials) if ranked is None else np.flatnonzero((ranked[:, 1:] == ranked[:, :-1]).any(1))
                for t in doubtful:  # long names, and digests that agree in 64 bits
                    order[t] = sorted(range(self.n), key=lambda p: hashlib.md5(self.heads[t] + x + self.tails[p]).digest())  # noqa: B023
                out.append(np.concatenate([np.arange(self.n)[None], order]))
        return out


class Values:
    """One command: signs and their values, and the words of the language's lexicon."""

    def __init__(self, signs: list[str], values: list[str], words: list[str], trials: int):
        if len(set(signs)) < len(signs):
            raise ValueError("a sign has two values")
        self.values, self.trials = values, trials
        self.at = {s: i for i, s in enumerate(signs) if len(s) == 1}
        self.chars = "".join(self.at)
        own = set("".join(values))
        self.words = {w for w in words if len(w) >= 3 and own.issuperset(w)}
        self.single = all(len(v) == 1 for v in values)
        letters = {v: i + 1 for i, v in enumerate(sorted(set(values)))}
        self.base = len(letters) + 1
        self.longest = 0
        while self.single and self.base ** (self.longest + 1) < 2**63:
            self.longest += 1
        self.longest = min(self.longest, 60)
        self.number = np.array([letters[v] for v in values] + [0], np.int64)
        known = np.array(sorted(sum(letters[x] * self.base**j for j, x in enumerate(w)) for w in self.words if len(w) <= self.longest), np.int64)
        self.known = known
        self.bits = max(12, min(24, int(len(known) * 16).bit_length()))
        self.marks = np.zeros(1 << self.bits, bool)
        self.marks[self._place(known)] = True

    def _place(self, x: np.ndarray) -> np.ndarray:
        return (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def covered(self, counts: dict[str, int]) -> list[tuple[str, int]]:
        return [(w, c) for w, c in counts.items() if not w.strip(self.chars)]

    def rates(self, words: list[tuple[str, int]], orders: np.ndarray) -> np.ndarray:
        """For each trial the share of uses whose decoded word of three signs is in the lexicon; NaN where none has three."""
        hits, seen = np.zeros(len(orders), np.int64), np.zeros(len(orders), np.int64)
        plain = [(w, c) for w, c in words if not self.single or len(w) > self.longest]
        short = [(w, c) for w, c in words if self.single and 3 <= len(w) <= self.longest]
        if short:
            uses = np.array([c for _, c in short], np.int64)
            seen += uses.sum()
            if len(self.known):
                signs = np.full((max(len(w) for w, _ in short), len(short)), len(self.values), np.int64)
                for i, (w, _) in enumerate(short):
                    signs[: len(w), i] = [self.at[x] for x in w]
                number = np.zeros((len(self.values) + 1, len(orders)), np.int64)
                number[:-1] = self.number[orders.T]
                code = number[signs[-1]]
                for row in signs[-2::-1]:
                    code *= self.base
                    code += number[row]
                i, t = np.nonzero(self.marks[self._place(code)])
                x = code[i, t]
                at = np.minimum(np.searchsorted(self.known, x), len(self.known) - 1)
                right = self.known[at] == x
                hits += np.bincount(t[right], weights=uses[i[right]], minlength=len(orders)).astype(np.int64)
        if plain:
            for t, order in enumerate(orders):
                m = {ord(s): self.values[order[i]] for s, i in self.at.items()}
                for w, c in plain:
                    read = w.translate(m)
                    if len(read) >= 3:
                        seen[t] += c
                        hits[t] += c * (read in self.words)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(seen > 0, hits / seen, np.nan)


def figures(rates: np.ndarray) -> tuple[float | None, float | None, int, int]:
    """The rate of the mapping itself, the sum of those of its shuffles, how many of them reach it and how many there are."""
    real, null = rates[0], rates[1:][~np.isnan(rates[1:])]
    return None if np.isnan(real) else float(real), fsum(null) if len(null) else None, int((null >= (0.0 if np.isnan(real) else real)).sum()), len(null)
