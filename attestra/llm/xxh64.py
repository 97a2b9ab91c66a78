"""XXH64 of many byte ranges of one buffer at once, by NumPy (algorithm: the public XXH64 specification)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Shingles hashed at once, a bound on memory.
BLOCK = 1 << 16

# Fixed values of the XXH64 specification.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Ranges longer than this are hashed one by one.
LONG = 512


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotate(acc + lane * P2, 31) * P1


def hash_ranges(buffer: bytes, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Hashes (uint64) of buffer[start:start+size] for each pair. buffer: at least 8 bytes longer than the last range."""
    order = np.argsort(size, kind="stable")[::-1]  # longest first: what still has bytes left is always a prefix
    at, left = start[order].astype(np.int64), size[order].astype(np.int64)
    raw = np.frombuffer(buffer, np.uint8)
    lanes8 = np.ndarray((len(buffer) - 7,), "<u8", buffer, 0, (1,))
    lanes4 = np.ndarray((len(buffer) - 3,), "<u4", buffer, 0, (1,))
    h = np.full(len(at), np.uint64((seed + int(P5)) % 2**64))
    longest, full = left.copy(), left // 32
    n = int(np.count_nonzero(full))
    if n:
        v = [np.full(n, np.uint64(x % 2**64)) for x in (seed + int(P1) + int(P2), seed + int(P2), seed, seed - int(P1))]
        for stripe in range(int(full[0])):
            m = int(np.count_nonzero(full[:n] > stripe))
            for k in range(4):
                v[k][:m] = _round(v[k][:m], lanes8[at[:m] + (32 * stripe + 8 * k)])
        x = _rotate(v[0], 1) + _rotate(v[1], 7) + _rotate(v[2], 12) + _rotate(v[3], 18)
        for k in range(4):
            x = (x ^ _round(np.zeros(n, np.uint64), v[k])) * P1 + P4
        h[:n] = x
    h += longest.astype(np.uint64)
    at += full * 32
    left -= full * 32
    for _ in range(3):
        i = np.flatnonzero(left >= 8)
        h[i] = _rotate(h[i] ^ _round(np.zeros(len(i), np.uint64), lanes8[at[i]]), 27) * P1 + P4
        at[i] += 8
        left[i] -= 8
    i = np.flatnonzero(left >= 4)
    h[i] = _rotate(h[i] ^ (lanes4[at[i]].astype(np.uint64) * P1), 23) * P2 + P3
    at[i] += 4
    left[i] -= 4
    for _ in range(3):
        i = np.flatnonzero(left > 0)
        h[i] = _rotate(h[i] ^ (raw[at[i]].astype(np.uint64) * P5), 11) * P1
        at[i] += 1
        left[i] -= 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    out = np.empty(len(h), np.uint64)
    out[order] = h
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh64_intdigest(buffer[start[i] : start[i] + size[i]], seed)
    return out


def shingle_hashes(words: list[bytes], size: int, seed: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles of ``size`` words, space-joined, a block at a time; fewer words are one shingle, none give nothing."""
    total = max(1, len(words) - size + 1) if words else 0
    for first in range(0, total, BLOCK):
        part = words[first : first + BLOCK + size - 1]
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        k = max(1, len(part) - size + 1)
        yield hash_ranges(b" ".join(part) + bytes(8), starts[:k], ends[len(part) - k :] - starts[:k], seed)
