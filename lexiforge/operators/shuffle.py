"""Shuffling a document's signs in the order of md5 (A14), for many documents at once.

The order is that of md5 of "key:place", which any engine reproduces. Sorting hex strings in the JVM costs microseconds a sign;
here the digests of a block of places are computed together in arrays of words, and nothing leaves the document's row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

#: Messages hashed together: as many as stay in a core's cache.
BLOCK = 8192
_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = (np.abs(np.sin(np.arange(1, 65, dtype=np.float64))) * 2**32).astype(np.uint64).astype(np.uint32)
_WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]


def md5_keys(m: np.ndarray) -> np.ndarray:
    """The first 64 bits, in the order of the hex digest, of md5 of messages of one padded block, rows of 64 bytes."""
    words = np.ascontiguousarray(m.view("<u4").T)
    used = words.any(axis=1)
    n = len(m)
    a, b, c, d = (np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f); np.bitwise_and(f, b, out=f); np.bitwise_xor(f, d, out=f)  # noqa: E702
        elif i < 32:
            np.bitwise_xor(b, c, out=f); np.bitwise_and(f, d, out=f); np.bitwise_xor(f, c, out=f)  # noqa: E702
        elif i < 48:
            np.bitwise_xor(b, c, out=f); np.bitwise_xor(f, d, out=f)  # noqa: E702
        else:
            np.invert(d, out=f); np.bitwise_or(f, b, out=f); np.bitwise_xor(f, c, out=f)  # noqa: E702
        f += a
        f += _SINES[i]
        if used[_WORDS[i]]:
            f += words[_WORDS[i]]
        np.left_shift(f, np.uint32(_SHIFTS[i]), out=g)
        np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=f)
        f |= g
        f += b
        a, d, c, b, f = d, c, b, f, a  # the array of a is free now
    a += np.uint32(0x67452301)
    b += np.uint32(0xEFCDAB89)
    return a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap().astype(np.uint64)


def _filled(m: np.ndarray, prefix: bytes, start: int) -> None:
    """Writes the messages prefix + place into zeroed rows, for places from start on."""
    p, stop = len(prefix), start + len(m)
    m[:, :p] = np.frombuffer(prefix, np.uint8)
    low = start
    while low < stop:
        d = len(str(low))
        high = min(stop, 10**d)
        rows, at = m[low - start : high - start], np.arange(low, high)
        for k in range(d - 1, -1, -1):
            rows[:, p + k] = at % 10 + 48
            at //= 10
        rows[:, p + d] = 0x80
        rows[:, 56], rows[:, 57] = (p + d) * 8 % 256, (p + d) * 8 // 256
        low = high


def orders(wanted: Iterable[tuple[str, int]]) -> Iterator[np.ndarray]:
    """For each (key, n) the places 0 to n - 1 in the order of md5 of "key:place"."""
    wanted = [(f"{key}:".encode("utf-8", "surrogatepass"), n) for key, n in wanted]
    short = [len(p) + len(str(n)) <= 55 for p, n in wanted]
    keys = [np.empty(n, np.uint64) for _, n in wanted]
    parts = [(at, s, min(n, s + BLOCK)) for at, (_, n) in enumerate(wanted) if short[at] for s in range(0, n, BLOCK)]
    while parts:
        size, k = 0, 0
        while k < len(parts) and (k == 0 or size + parts[k][2] - parts[k][1] <= BLOCK):
            size += parts[k][2] - parts[k][1]
            k += 1
        m, row = np.zeros((size, 64), np.uint8), 0
        for at, s, e in parts[:k]:
            _filled(m[row : row + e - s], wanted[at][0], s)
            row += e - s
        got, row = md5_keys(m), 0
        for at, s, e in parts[:k]:
            keys[at][s:e] = got[row : row + e - s]
            row += e - s
        parts = parts[k:]
    for (prefix, n), ok, key in zip(wanted, short, keys, strict=True):
        order = np.argsort(key) if ok else None
        if order is None or (key[order[1:]] == key[order[:-1]]).any():  # long keys, and digests that agree in 64 bits
            order = np.array(sorted(range(n), key=lambda i: hashlib.md5(prefix + str(i).encode()).digest()), np.int64)
        yield order


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def shuffled_texts(rows: list[tuple[str, str]]) -> Iterator[str]:
    """For each (key, words joined by line ends) the same lengths of words with the signs in the order of ``orders``."""
    all_codes = [codes(text) for _, text in rows]
    signs = [c != 10 for c in all_codes]
    for c, is_sign, order in zip(all_codes, signs, orders((key, int(s.sum())) for (key, _), s in zip(rows, signs, strict=True)), strict=True):
        out = c.copy()
        out[is_sign] = c[is_sign][order]
        yield out.tobytes().decode("utf-32-le", "surrogatepass")
