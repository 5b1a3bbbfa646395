"""Vectorised work on UTF-8 texts in Arrow buffers: words, rolling hashes, XXH64.

Everything works on a flat ``uint8`` array of many texts with ``int64`` offsets, in
slices of a few megabytes, so memory does not depend on the size of a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Any odd constants serve here; they only mix bits.
MIX1, MIX2, STEP = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)
SLICE_BYTES, PART_BYTES = 4 << 20, 1 << 20


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes; a longer text is alone in its range."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * MIX1
    h = (h ^ (h >> U64(29))) * MIX2
    return h ^ (h >> U64(32))


class _Powers:
    """Powers of STEP and of its inverse modulo 2**64, grown when a longer slice comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(1 << 20, 1 << (n - 1).bit_length())
            inverse = U64(pow(int(STEP), -1, 1 << 64))
            both = []
            for base in (STEP, inverse):
                row = np.full(n, base, U64)
                row[0] = 1
                both.append(np.multiply.accumulate(row))
            self.up, self.down = both
        return self.up, self.down


POWERS = _Powers()
_random = np.random.default_rng(20240229)
BYTE_VALUE = _random.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Words of letters and digits after lower-casing A-Z: 0-9, a-z and all bytes of non-ASCII characters.
ALNUM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Words between white space: all bytes but space and \t \n \v \f \r.
INK = ~byte_set((0x20, 0x20), (0x09, 0x0D))


class Words:
    """Words of the texts of one slice: byte ranges, 64-bit hashes, and where each text's words are.

    ``first[i]:first[i+1]`` are the words of text i.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, inside: np.ndarray, lower: bool = True, hashed: bool = True):
        n = len(data)
        m = inside[data]
        begin, end = m.copy(), m.copy()
        if n:
            begin[1:] &= ~m[:-1]
            end[:-1] &= ~m[1:]
            full = off[:-1][off[:-1] < off[1:]]
            begin[full] = m[full]
            last = off[1:][off[:-1] < off[1:]] - 1
            end[last] = m[last]
        self.start = np.flatnonzero(begin)
        self.stop = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, off).astype(np.int64)
        self.count = np.diff(self.first)
        if hashed:
            value = np.where(inside, BYTE_VALUE[LOWER] if lower else BYTE_VALUE, U64(0))
            parts, i = [], 0
            while i < len(self.start):  # a megabyte at a time: many bytes are held for each byte
                j = max(i + 1, int(np.searchsorted(self.stop, self.start[i] + PART_BYTES, side="right")))
                a, b = int(self.start[i]), int(self.stop[j - 1])
                parts.append(spans_hash(value[data[a:b]], self.start[i:j] - a, self.stop[i:j] - a))
                i = j
            self.hash = np.concatenate(parts) if parts else np.zeros(0, U64)

    def text_of(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)


def spans_hash(value: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of value[start:stop] for disjoint ascending spans; what lies between them must be 0."""
    if not len(start):
        return np.zeros(0, U64)
    up, down = POWERS.get(len(value))
    total = np.add.reduceat(value * up[: len(value)], start)
    return mix(total * down[start] + (stop - start).astype(U64) * MIX2)


def rolling_hash(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of data[i:i+k] for every i; the last k-1 entries mean nothing."""
    n = len(data)
    out, done, have, base, width = None, 0, BYTE_VALUE[data], STEP, 1
    while True:
        if k & width:
            if out is None:
                out, done = have.copy(), width
            else:  # out covers the first `done` bytes, `have` the next `width`
                out *= base
                out[: max(0, n - done)] += have[done:]
                done += width
        if width * 2 > k:
            return mix(out)
        wider = have * base
        wider[: n - width] += have[width:]
        have, width = wider, width * 2
        with np.errstate(over="ignore"):
            base = base * base


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of values[i:i+w] for every i with a whole window, by doubling."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    cur, width = values, 1
    while width * 2 <= w:
        cur = np.minimum(cur[:-width], cur[width:])
        width *= 2
    return cur[:n] if width == w else np.minimum(cur[:n], cur[w - width : w - width + n])


# XXH64, after its published specification: fixed values.
P64 = tuple(U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P64[1], 31) * P64[0]


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of data[start:start+length] for many (overlapping) spans at once."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    half = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    at, left = start.astype(np.int64), length.astype(np.int64)
    with np.errstate(over="ignore"):
        s = U64(seed)
        h = np.full(len(at), s + P64[4], U64)
        big = np.flatnonzero(left >= 32)
        if len(big):
            v = [np.full(len(big), x, U64) for x in (s + P64[0] + P64[1], s + P64[1], s, s - P64[0])]
            pos, rest = at[big].copy(), left[big].copy()
            live = np.arange(len(big))
            while len(live):
                for k in range(4):
                    v[k][live] = _round(v[k][live], lanes[pos[live] + 8 * k])
                pos[live] += 32
                rest[live] -= 32
                live = live[rest[live] >= 32]
            hb = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for k in range(4):
                hb = (hb ^ _round(np.zeros(len(big), U64), v[k])) * P64[0] + P64[3]
            h[big] = hb
            at, left = at.copy(), left.copy()
            at[big], left[big] = pos, rest
        h += length.astype(U64)
        at, left = at.copy(), left.copy()
        zero = U64(0)
        for _ in range(3):
            live = np.flatnonzero(left >= 8)
            if not len(live):
                break
            k1 = _rotl(lanes[at[live]] * P64[1], 31) * P64[0]
            h[live] = _rotl(h[live] ^ (k1 + zero), 27) * P64[0] + P64[3]
            at[live] += 8
            left[live] -= 8
        live = np.flatnonzero(left >= 4)
        if len(live):
            h[live] = _rotl(h[live] ^ (half[at[live]].astype(U64) * P64[0]), 23) * P64[1] + P64[2]
            at[live] += 4
            left[live] -= 4
        for _ in range(3):
            live = np.flatnonzero(left >= 1)
            if not len(live):
                break
            h[live] = _rotl(h[live] ^ (padded[at[live]].astype(U64) * P64[4]), 11) * P64[0]
            at[live] += 1
            left[live] -= 1
        h ^= h >> U64(33)
        h *= P64[1]
        h ^= h >> U64(29)
        h *= P64[2]
        return h ^ (h >> U64(32))


POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x) if hasattr(np, "bitwise_count") else POPCOUNT[x.view(np.uint16).reshape(-1, 4)].sum(1)


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for each span, concatenated."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(start - (ends - count), count)


def squeeze(values: np.ndarray, ascending: bool = False) -> bytes:
    """Unsigned 32-bit integers as compressed byte planes; of ascending ones the differences."""
    v = values.astype("<u4")
    if ascending and len(v):
        v = np.concatenate([v[:1], np.diff(v)]).astype("<u4")
    raw = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 4).T)
    return pack_bytes(raw.tobytes())


def unsqueeze(blob: bytes, ascending: bool = False) -> np.ndarray:
    raw = np.frombuffer(unpack_bytes(blob), np.uint8).reshape(4, -1)
    v = np.ascontiguousarray(raw.T).view("<u4").ravel()
    return np.cumsum(v, dtype=np.uint32) if ascending else v


def squeeze_codes(codes: np.ndarray) -> bytes:
    """64-bit integers in ascending order: their upper and lower halves, each compressed."""
    codes = np.sort(codes)
    upper = squeeze(codes >> U64(32), ascending=True)
    return len(upper).to_bytes(8, "little") + upper + squeeze(codes & U64(0xFFFFFFFF))


def unsqueeze_codes(blob: bytes) -> np.ndarray:
    n = 8 + int.from_bytes(blob[:8], "little")
    return unsqueeze(blob[8:n], ascending=True).astype(U64) << U64(32) | unsqueeze(blob[n:])


ZSTD = pa.Codec("zstd", compression_level=5)


def pack_bytes(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + (ZSTD.compress(raw, asbytes=True) if raw else b"")


def unpack_bytes(blob: bytes) -> bytes:
    n = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], decompressed_size=n, codec="zstd", asbytes=True) if n else b""
