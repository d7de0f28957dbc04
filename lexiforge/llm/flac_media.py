"""FLAC media columns: mono streams with Rice-coded residuals of linear predictors.

Encoding and decoding run many frames in step: one NumPy operation handles the same sample of every frame of
a chunk, so the cost of a sample does not depend on how the samples are spread over documents. Decoding
verifies each frame header's CRC-8, each frame's CRC-16 and the stream's MD5, handles constant, verbatim,
fixed and LPC subframes, both Rice methods, partitions and escapes, and finds frames by the seek table's
sample offsets, or one after another where the table does not list each frame.

Streams that this module writes: 8 bits, blocks of 576 samples, a seek point for every frame; each frame has
the cheapest of constant, verbatim, fixed order 0 to 2 and LPC order 2.

Defined results: null text counts as empty; a payload is padded with bytes 255 to a positive multiple of
576, so the empty text has one block; equal texts have equal streams; a damaged stream raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import from_worker, materialise, to_worker

BLOCK = 576
RATE = 8000
#: Frames that are handled in step; bounds a worker's memory.
CHUNK = 3000
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
PRECISION, SHIFT = 12, 9


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for v in range(256):
        v <<= bits - 8
        for _ in range(8):
            v = (v << 1) ^ (poly if v & top else 0)
        out.append(v & mask)
    return np.array(out, np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(raw: np.ndarray, start: np.ndarray, size: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """CRC of each raw[start:start+size]; zeros before a message do not change a CRC that starts at 0."""
    most = int(size.max(initial=0))
    crc = np.zeros(len(start), np.uint16)
    for j in range(most):
        at = start + size - most + j
        byte = np.where(at >= start, raw[np.maximum(at, 0)], 0)
        crc = table[(crc >> (bits - 8)) ^ byte] ^ ((crc << 8) if bits == 16 else np.uint16(0))
    return crc


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _rice(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cheapest parameter, bits) for the residuals of each frame (columns)."""
    z, n = _zigzag(r), len(r)
    guess = np.clip(np.floor(np.log2(np.maximum(z.mean(0) * 0.69, 1e-9))), 0, 13).astype(np.int32)
    cost = [(z >> k).sum(0) + n * (k + 1) for k in (guess, guess + 1)]
    return np.where(cost[1] < cost[0], guess + 1, guess), np.minimum(*cost)


def _predict(x: np.ndarray, coefs: np.ndarray, shift: int) -> np.ndarray:
    """Residuals after the warm-up; coefs: (order, frames)."""
    p, n = len(coefs), len(x)
    if not p:
        return x
    s = np.zeros((n - p, x.shape[1]), np.int32)
    for j in range(p):
        s += coefs[j] * x[p - 1 - j : n - 1 - j]
    return x[p:] - (s >> shift)


def _lpc2(x: np.ndarray) -> np.ndarray:
    """Quantised order-2 coefficients of each frame by its autocorrelation."""
    f = x.astype(np.float32)
    r = [(f[: len(f) - k] * f[k:]).sum(0) for k in range(3)]
    det = np.maximum(r[0] ** 2 - r[1] ** 2, 1e-6)
    a = np.stack([r[1] * (r[0] - r[2]), r[0] * r[2] - r[1] ** 2]) / det
    top = 1 << (PRECISION - 1)
    return np.clip(np.round(np.nan_to_num(a) * (1 << SHIFT)), -top, top - 1).astype(np.int32)


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x: (BLOCK, frames) int32 samples of 8 bits; the bytes of all frames in one array, and where each begins (and the end)."""
    n, f = x.shape
    lpc = _lpc2(x)
    plans = [(8 + p, np.array(FIXED[p], np.int32).reshape(-1, 1), 0, 8 * p + 10) for p in range(3)] + [(33, lpc, SHIFT, 16 + 9 + 2 * PRECISION + 10)]
    best, kind, k = np.full(f, 8 * n), np.where((x == x[0]).all(0), 0, 1), np.zeros(f, np.int32)
    best[kind == 0] = 8
    residual = np.zeros((n, f), np.int32)
    for code, coefs, shift, extra in plans:
        r = _predict(x, coefs, shift)
        param, cost = _rice(r)
        win = cost + extra < best
        best, kind, k = np.where(win, cost + extra, best), np.where(win, code, kind), np.where(win, param, k)
        residual[n - len(r) :, win] = r[:, win]
    long = np.select([numbers < 0x80, numbers < 0x800, numbers < 0x10000], [1, 2, 3], 4)
    head = 4 + long  # without the CRC-8
    size = head + 1 + (8 + best + 7) // 8 + 2
    start = np.concatenate([[0], np.cumsum(size)])
    bits = np.zeros(8 * int(start[-1]), np.uint8)
    s = 8 * start[:-1]
    for j, byte in enumerate((0xFF, 0xF8, 0x24, 0x02)):
        _put(bits, s + 8 * j, np.full(f, byte), 8)
    for m in (1, 2, 3, 4):
        own = np.flatnonzero(long == m)
        v = numbers[own]
        for j in range(m):
            rest = v >> (6 * (m - 1 - j))
            _put(bits, s[own] + 32 + 8 * j, v if m == 1 else ((0xF00 >> m) & 0xFF | rest) if j == 0 else 0x80 | rest & 0x3F, 8)
    at = s + 8 * (head + 1)
    _put(bits, at, kind << 1, 8)
    at = at + 8
    own = np.flatnonzero(kind == 0)
    _put(bits, at[own], x[0, own] & 0xFF, 8)
    own = np.flatnonzero(kind == 1)
    if len(own):
        _put(bits, at[own] + 8 * np.arange(n)[:, None], x[:, own] & 0xFF, 8)
    for code, coefs, shift, extra in plans:
        own = np.flatnonzero(kind == code)
        if not len(own):
            continue
        p = len(coefs)
        for j in range(p):
            _put(bits, at[own] + 8 * j, x[j, own] & 0xFF, 8)
        here = at[own] + 8 * p
        if code == 33:
            _put(bits, here, np.full(len(own), (PRECISION - 1) << 5 | shift), 9)
            for j in range(p):
                _put(bits, here + 9 + PRECISION * j, coefs[j, own] & ((1 << PRECISION) - 1), PRECISION)
        here = at[own] + extra - 10
        _put(bits, here, k[own], 10)  # method 0, one partition, its parameter
        z, ks = _zigzag(residual[p:, own]), k[own]
        width = (z >> ks) + 1 + ks
        stop = here + 10 + np.cumsum(width, 0) - ks - 1
        bits[stop] = 1
        for b in range(int(ks.max(initial=0))):
            some = np.flatnonzero(ks > b)
            bits[stop[:, some] + ks[some] - b] = (z[:, some] >> b) & 1
    raw = np.packbits(bits)
    raw[start[:-1] + head] = _crc(raw, start[:-1], head, CRC8, 8)
    check = _crc(raw, start[:-1], size - 2, CRC16, 16)
    raw[start[1:] - 2], raw[start[1:] - 1] = check >> 8, check & 0xFF
    return raw, start


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; payload sizes are positive multiples of BLOCK."""
    counts = [len(p) // BLOCK for p in payloads]
    numbers = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, int)
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    parts: list[bytes] = []
    sizes: list[np.ndarray] = []
    for i in range(0, len(samples), CHUNK):
        raw, start = encode_frames(np.ascontiguousarray(samples[i : i + CHUNK].T).astype(np.int32) - 128, numbers[i : i + CHUNK])
        parts.append(raw.tobytes())
        sizes.append(np.diff(start))
    body, size = b"".join(parts), np.concatenate(sizes) if sizes else np.zeros(0, int)
    ends = np.concatenate([[0], np.cumsum(size)])
    out, at = [], 0
    for payload, c in zip(payloads, counts, strict=True):
        own = size[at : at + c]
        pcm = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()  # signed samples
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
        points = np.zeros(c, dtype=[("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
        points["sample"], points["offset"], points["size"] = np.arange(c) * BLOCK, ends[at : at + c] - ends[at], BLOCK
        seek = points[: (1 << 24) // 18].tobytes()
        out.append(b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(seek).to_bytes(3, "big") + seek + body[ends[at] : ends[at + c]])
        at += c
    return out


class _Bits:
    """Reads fields at a bit position of each frame from windows of 64 bits."""

    def __init__(self, raw: np.ndarray):
        padded = np.concatenate([raw, np.zeros(16, np.uint8)])
        self.window = np.zeros(len(raw) + 8, np.uint64)
        for j in range(8):
            self.window |= padded[j : j + len(raw) + 8].astype(np.uint64) << np.uint64(56 - 8 * j)

    def peek(self, at: np.ndarray) -> np.ndarray:
        return self.window[np.minimum(at >> 3, len(self.window) - 1)] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, width: int) -> np.ndarray:
        return (self.peek(at) >> np.uint64(64 - width)).astype(np.int64) if width else np.zeros(len(at), np.int64)

    def signed(self, at: np.ndarray, width: int) -> np.ndarray:
        v = self.take(at, width)
        return v - ((v >> (width - 1)) << width) if width else v

    def rice(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, zeros = self.peek(at), np.zeros(len(at), np.int64)
        top = w >> np.uint64(32)
        while not top.all():
            empty = top == 0
            zeros += 32 * empty
            if (at + zeros >= 8 * len(self.window)).any():
                raise ValueError("a Rice code runs over the end of the data")
            w = self.peek(at + zeros)
            top = np.where(empty, w >> np.uint64(32), top) if empty.all() else w >> np.uint64(32)
        lead = 32 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
        low = (w << (lead + 1).astype(np.uint64)) >> np.uint64(1) >> (63 - k).astype(np.uint64)
        z = (zeros + lead) << k | low.astype(np.int64)
        return (z >> 1) ^ -(z & 1), at + zeros + lead + 1 + k


def _residual(bits: _Bits, at: np.ndarray, order: int, n: int, out: np.ndarray) -> np.ndarray:
    """Fill out[order:] and give the positions after the residuals; frames may differ in method and partitions."""
    method, parts = bits.take(at, 2), bits.take(at + 2, 4)
    if (method > 1).any():
        raise ValueError("a reserved residual coding")
    end = at.copy()
    for m, po in {(int(a), int(b)) for a, b in zip(method, parts, strict=True)}:
        own = np.flatnonzero((method == m) & (parts == po))
        pos, width = at[own] + 6, 4 + m
        for part in range(1 << po):
            lo, hi = part * (n >> po) + (order if part == 0 else 0), (part + 1) * (n >> po)
            k = bits.take(pos, width)
            pos = pos + width
            raw_size = np.where(k == (1 << width) - 1, bits.take(pos, 5), -1)
            for size in set(raw_size.tolist()):
                some = np.flatnonzero(raw_size == size)
                p = pos[some] + (5 if size >= 0 else 0)
                for i in range(lo, hi):
                    if size >= 0:
                        out[i, own[some]], p = bits.signed(p, size), p + size
                    else:
                        out[i, own[some]], p = bits.rice(p, k[some])
                pos[some] = p
        end[own] = pos
    return end


def decode_frames(raw: np.ndarray, start: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(samples of each frame, frame numbers, ends) of mono frames that begin at start; raises ValueError on damage."""
    bits, f = _Bits(raw), len(start)
    at = 8 * start
    head = bits.take(at, 32)
    if ((head >> 17) != 0x7FFC).any() or ((head >> 4) & 15).any():
        raise ValueError("no frame of one channel here")
    lead = bits.take(at + 32, 8)
    long = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    number = np.where(long == 1, lead, lead & (0x7F >> long))
    for j in range(1, int(long.max(initial=1))):
        number = np.where(long > j, number << 6 | bits.take(at + 32 + 8 * j, 8) & 0x3F, number)
    code, rate = (head >> 12) & 15, (head >> 8) & 15
    pos = at + 32 + 8 * long
    n = np.select([code == 1, (code >= 2) & (code <= 5), code == 6, code == 7], [np.full(f, 192), 576 << np.maximum(code - 2, 0), bits.take(pos, 8) + 1, bits.take(pos, 16) + 1], 256 << np.maximum(code - 8, 0))
    pos = pos + np.select([code == 6, code == 7], [8, 16], 0) + np.select([rate == 12, rate == 13, rate == 14], [8, 16, 16], 0)
    if (_crc(raw, start, (pos >> 3) - start, CRC8, 8) != bits.take(pos, 8)).any():
        raise ValueError("a frame header's CRC is wrong")
    pos = pos + 8
    kind = bits.take(pos, 8) >> 1
    if (bits.take(pos, 8) & 1).any():
        raise ValueError("wasted bits are not supported")
    pos = pos + 8
    samples: list[np.ndarray] = [np.zeros(0, np.int64)] * f
    for t, size in {(int(a), int(b)) for a, b in zip(kind, n, strict=True)}:
        own = np.flatnonzero((kind == t) & (n == size))
        p, x = pos[own], np.zeros((size, len(own)), np.int64)
        if t == 0:
            x[:], p = bits.signed(p, width), p + width
        elif t == 1:
            for i in range(size):
                x[i], p = bits.signed(p, width), p + width
        elif 8 <= t <= 12 or t >= 32:
            order = t - 8 if t < 32 else t - 31
            for i in range(order):
                x[i], p = bits.signed(p, width), p + width
            shift, coefs = np.zeros(len(own), np.int64), np.array(FIXED[order] if t < 32 else [0] * order, np.int64).reshape(-1, 1) + np.zeros(len(own), np.int64)
            if t >= 32:
                precision, shift, p = bits.take(p, 4) + 1, bits.signed(p + 4, 5), p + 9
                if (precision == 16).any() or (shift < 0).any():
                    raise ValueError("reserved predictor values")
                for j in range(order):
                    v = bits.peek(p) >> (64 - precision).astype(np.uint64)
                    v = v.astype(np.int64)
                    coefs[j], p = v - ((v >> (precision - 1)) << precision), p + precision
            p = _residual(bits, p, order, size, x)
            for i in range(order, size):
                s = coefs[0] * x[i - 1] if order else 0
                for j in range(1, order):
                    s = s + coefs[j] * x[i - 1 - j]
                if order:
                    x[i] += s >> shift
        else:
            raise ValueError("a reserved subframe type")
        pos[own] = p
        rows = np.ascontiguousarray(x.T)
        for i, j in enumerate(own):
            samples[j] = rows[i]
    end = (pos + 7) >> 3
    if (end + 2 > len(raw)).any() or (_crc(raw, start, end - start, CRC16, 16) != bits.take(8 * end, 16)).any():
        raise ValueError("a frame's CRC is wrong")
    return samples, number, end + 2


def parse_metadata(stream: bytes) -> tuple[dict, int]:
    """(STREAMINFO fields with the seek points, where frames begin)."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, info = 4, {"points": np.zeros(0, dtype=[("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])}
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind & 127 == 0:
            packed = int.from_bytes(body[10:18], "big")
            info |= {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34], "max_block": int.from_bytes(body[2:4], "big")}
        elif kind & 127 == 3:
            info["points"] = np.frombuffer(body, info["points"].dtype)
        at += 4 + size
        if kind & 128:
            return info, at


def seek(stream: bytes, sample: int) -> tuple[int, int]:
    """(first sample, byte position) of the last seek point at or before a sample."""
    info, begin = parse_metadata(stream)
    before = info["points"][info["points"]["sample"] <= sample]
    return (int(before[-1]["sample"]), begin + int(before[-1]["offset"])) if len(before) else (0, begin)


def decode_streams(streams: list[bytes]) -> list[np.ndarray]:
    """The samples of each mono stream of 8 bits or the width it names."""
    infos = [parse_metadata(s) for s in streams]
    starts, owner, base = [], [], 0
    for i, (s, (info, begin)) in enumerate(zip(streams, infos, strict=True)):
        p = info["points"]
        if int(p["size"].sum()) == info["samples"]:  # a point for each frame
            starts.append(base + begin + p["offset"].astype(np.int64))
            owner.append(np.full(len(p), i))
        base += len(s)
    out: list = [[] for _ in streams]
    if starts:
        raw, at, own = np.frombuffer(b"".join(streams), np.uint8), np.concatenate(starts), np.concatenate(owner)
        for width in {x[0]["bits"] for x in infos}:
            some = np.flatnonzero(np.array([infos[i][0]["bits"] == width for i in own]))
            for c in range(0, len(some), CHUNK):
                part = some[c : c + CHUNK]
                lo, hi = int(at[part[0]]), int(at[part[-1] + 1]) + 64 if part[-1] + 1 < len(at) else len(raw)
                for i, x in zip(own[part], decode_frames(raw[lo:hi], at[part] - lo, width)[0], strict=True):
                    out[i].append(x)
    for i, (s, (info, begin)) in enumerate(zip(streams, infos, strict=True)):
        have, at = sum(map(len, out[i])), begin
        if not have and info["samples"]:  # no full seek table: one frame after another
            data = np.frombuffer(s, np.uint8)
            while have < info["samples"]:
                (x,), _, (size,) = decode_frames(data[at:], np.array([0]), info["bits"])
                out[i].append(x)
                have, at = have + len(x), at + int(size)
        x = np.concatenate(out[i]) if out[i] else np.zeros(0, np.int64)
        if len(x) != info["samples"]:
            raise ValueError("samples are missing")
        if info["bits"] == 8 and any(info["md5"]) and hashlib.md5(x.astype(np.int8).tobytes()).digest() != info["md5"]:
            raise ValueError("the stream's MD5 is wrong")
        out[i] = x
    return out


def pad(raw: bytes) -> bytes:
    """raw and bytes 255 up to a positive multiple of BLOCK."""
    return raw + b"\xff" * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def describe(x: np.ndarray) -> str:
    """A stream's features: mean, root mean square, share of sign changes, and the least and largest sample."""
    v = x.astype(np.float64)
    return f"mean={v.mean():.4f};rms={np.sqrt((v * v).mean()):.4f};turns={np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)) / len(x):.6f};min={x.min()};max={x.max()}"


def _groups(b: pd.DataFrame, most: int = 2 * CHUNK * BLOCK) -> Iterator[tuple[list, list[bytes]]]:
    """Keys and raw texts of a batch in groups of bounded bytes; a longer text is a group of its own."""
    keys: list = []
    texts: list[bytes] = []
    size = 0
    for key, t in zip(b["key"], b["content"], strict=True):
        raw = t.encode("utf-8", "surrogatepass")
        if size and size + len(raw) > most:
            yield keys, texts
            keys, texts, size = [], [], 0
        keys.append(key)
        texts.append(raw)
        size += len(raw)
    if keys:
        yield keys, texts


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (of the text), media (a FLAC stream of the padded UTF-8 text) for each row; a narrow pass."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for keys, texts in _groups(b):
                yield pd.DataFrame({"key": keys, "n_bytes": list(map(len, texts)), "media": encode_streams([pad(t) for t in texts])})

    keyed = docs.select(to_worker(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    out = keyed.mapInPandas(run, "key string, n_bytes long, media binary")
    return out.select(from_worker("key", kind).alias(id_col), "n_bytes", "media")


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", column: str = "media") -> DataFrame:
    """id, sample_offset, pcm for each block of each stream: verified, decoded, and seekable by sample_offset."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, s in zip(b["key"], b["media"], strict=True):
                info, _ = parse_metadata(s)
                x, step = decode_streams([s])[0].astype(np.int8 if info["bits"] == 8 else "<i4"), info["max_block"]
                at = range(0, len(x), step)
                yield pd.DataFrame({"key": [key] * len(at), "sample_offset": list(at), "pcm": [x[i : i + step].tobytes() for i in at]})

    out = media.select(to_worker(id_col).alias("key"), F.col(column).alias("media")).mapInPandas(run, "key string, sample_offset long, pcm binary")
    return out.select(from_worker("key", kind).alias(id_col), "sample_offset", "pcm")


def _stored(b: pd.DataFrame, most: int = 2 * CHUNK * BLOCK) -> Iterator[pd.DataFrame]:
    """Runs of rows whose texts have bounded bytes."""
    size = b["n_bytes"].to_numpy()
    nth = (np.cumsum(size) - size) // most
    for _, part in b.groupby(nth, sort=False):
        yield part


def describe_media(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the stored streams of ``to_media`` hold when they are read back: sizes, digests, feature; a narrow pass."""
    kind = media.schema[id_col].dataType.simpleString()
    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _stored(b):
                rows = []
                for key, n, m, x in zip(part["key"], part["n_bytes"], part["media"], decode_streams(list(part["media"])), strict=True):
                    payload = ((x + 128).astype(np.uint8)).tobytes()
                    rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), describe(x)))
                yield pd.DataFrame(rows, columns=names)

    keyed = media.select(to_worker(id_col).alias("key"), "n_bytes", "media")
    out = keyed.mapInPandas(run, "key string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.select(from_worker("key", kind).alias(id_col), *names[1:])


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as a FLAC stream in the shared folder, read the stored column back and describe what was read."""
    stored = materialise(docs.sparkSession, to_media(docs, id_col, text_col), "media", codec="zstd")
    return describe_media(stored, id_col)
