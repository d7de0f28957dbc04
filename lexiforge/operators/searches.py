"""Many searches of sign values at once (J11-J14): what ``compare.Search`` does, a step of every search by the same few array operations.

Short texts have few trigrams, so most of a search's time went to the calls of a step. Here each search keeps its own stream of
random numbers and draws from it as ``numpy.random.Generator`` does, and scores are sums of whole numbers, so that it goes the way that it goes alone.
"""

from __future__ import annotations

import numpy as np

#: Steps between refills; words of 64 bits that a search can use in a step: three draws below a bound and two real numbers.
STEPS, DRAWS = 128, 6
#: Trigrams of a text up to which it is searched with others; searches at once.
SHORT, TOGETHER = 128, 256
#: Scores are in parts of one: sums in any order are equal, so exchanges that change nothing are known as such.
FINE = 2.0**32
_LOW = np.uint64(0xFFFFFFFF)


def fixed(logp: np.ndarray) -> np.ndarray:
    """Log probabilities in whole numbers of 1 / FINE."""
    return np.rint(logp * FINE).astype(np.int64)


class Streams:
    """A default_rng for each seed, drawn from by those that a mask names."""

    def __init__(self, seeds: list[int]):
        self.bits = [np.random.default_rng(s).bit_generator for s in seeds]
        self.buffer = np.stack([b.random_raw(STEPS * DRAWS) for b in self.bits])
        n = len(seeds)
        self.row, self.at = np.arange(n), np.zeros(n, np.int64)
        self.half, self.kept = np.zeros(n, bool), np.zeros(n, np.uint64)

    def refilled(self) -> None:
        for i, used in enumerate(self.at.tolist()):
            if used:
                self.buffer[i] = np.concatenate([self.buffer[i, used:], self.bits[i].random_raw(used)])
        self.at[:] = 0

    def _next(self, who: np.ndarray) -> np.ndarray:
        if self.at.max() >= self.buffer.shape[1]:  # only after many draws that were refused
            self.refilled()
        x = self.buffer[self.row, self.at]
        self.at += who
        return x

    def real(self, who: np.ndarray) -> np.ndarray:
        return (self._next(who) >> np.uint64(11)) * 2.0**-53

    def below(self, n: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Lemire's draws below n by halves of 64 bits; below 1 nothing is drawn."""
        wide = n.astype(np.uint64)
        out, who = np.zeros(len(n), np.int64), who & (n > 1)
        while who.any():
            fresh = who & ~self.half
            x = self._next(fresh)
            m = np.where(fresh, x & _LOW, self.kept) * wide
            self.kept = np.where(fresh, x >> np.uint64(32), self.kept)
            self.half ^= who
            low = m & _LOW
            again = who & (low < wide)
            if again.any():
                again &= low < (np.uint64(2**32) - wide) % np.maximum(wide, np.uint64(1))
            out = np.where(who & ~again, (m >> np.uint64(32)).astype(np.int64), out)
            who = again
        return out


def best(searches: list, iterations: int, restarts: int, seeds: list[int]) -> list[dict[str, str]]:
    """``Search.best`` of each search and its seed."""
    found: list[dict[str, str]] = [{} for _ in searches]
    order = sorted((i for i, s in enumerate(searches) if s.signs), key=lambda i: len(searches[i].grams))
    for a in range(0, len(order), TOGETHER):
        some = order[a : a + TOGETHER]
        for i, m in zip(some, _together([searches[i] for i in some], iterations, restarts, [seeds[i] for i in some]), strict=True):
            found[i] = {sign: searches[i].letters[m[k + 1]] for k, sign in enumerate(searches[i].signs)}
    return found


def _together(searches: list, iterations: int, restarts: int, seeds: list[int]) -> np.ndarray:
    n, streams = len(searches), Streams(seeds)
    row, everyone = np.arange(n), np.ones(n, bool)
    signs = np.array([len(s.signs) for s in searches])
    letters = np.array([len(s.letters) for s in searches])
    wide, most = int(signs.max()) + 1, max(len(s.grams) for s in searches)
    grams, weight = np.zeros((3, n, most), np.int64), np.zeros((n, most), np.int64)
    for i, s in enumerate(searches):
        grams[:, i, : len(s.grams)], weight[i, : len(s.grams)] = s.grams.T, s.weight
    place = grams + (row * wide)[None, :, None]
    tables, first = [], {}
    for s in searches:
        if id(s.logp) not in first:
            first[id(s.logp)] = sum(map(len, tables))
            tables.append(s.logp.ravel())
    logp, base, k = np.concatenate(tables), np.array([first[id(s.logp)] for s in searches])[:, None], letters[:, None]
    liked = lambda m: logp.take((m.take(place[0]) * k + m.take(place[1])) * k + m.take(place[2]) + base)
    start = np.zeros((n, wide), np.int64)
    for i in range(n):
        start[i, 1 : signs[i] + 1] = 1 + np.arange(signs[i]) % (letters[i] - 1)
    chosen, top = start.copy(), np.full(n, np.iinfo(np.int64).min)
    for r in range(restarts):
        m = start.copy()
        for nth in range(int(signs.max()) // 3 if r else 0):
            if nth % STEPS == 0:
                streams.refilled()
            who = nth < signs // 3
            a, b = 1 + streams.below(signs, who), 1 + streams.below(signs, who)
            x, y = m[row, a], m[row, b]
            m[row, a], m[row, b] = np.where(who, y, x), np.where(who, x, m[row, b])
        frees = [[x for x in range(1, letters[i]) if x not in set(m[i, 1 : signs[i] + 1].tolist())] for i in range(n)]
        n_free = np.array([len(x) for x in frees])
        free = np.zeros((n, max(1, int(n_free.max()))), np.int64)
        for i, x in enumerate(frees):
            free[i, : len(x)] = x
        now, heat = liked(m), 20.0
        score = (weight * now).sum(1)
        for step in range(iterations):
            if step % STEPS == 0:
                streams.refilled()
            i = 1 + streams.below(signs, everyone)
            some = n_free > 0
            take = some & (streams.real(some) < 0.3)
            at = streams.below(n_free, take)
            j = np.where(take, i, 1 + streams.below(signs, ~take))
            old, other = m[row, i], m[row, j]
            new = np.where(take, free[row, at], other)
            m[row, j] = old
            m[row, i] = new
            then = liked(m)
            gain = (weight * (then - now)).sum(1)
            right = gain > 0
            unsure = ~right
            right |= unsure & (streams.real(unsure) < np.exp(np.minimum(gain, 0) / FINE / heat))
            wrong = np.flatnonzero(~right)
            m[wrong, i[wrong]] = old[wrong]
            m[wrong, j[wrong]] = other[wrong]
            then[wrong] = now[wrong]
            now = then
            score += np.where(right, gain, 0)
            freed = np.flatnonzero(right & take)
            free[freed, at[freed]] = old[freed]
            heat = max(heat * 0.999, 0.05)
        better = score > top
        chosen[better], top = m[better], np.where(better, score, top)
    return chosen
