"""Word hashes of whole Arrow batches, vectorised: no Python object per word."""

from __future__ import annotations

import hashlib

import numpy as np

_rng = np.random.default_rng(0x5EED)
#: A random odd-ish 64-bit number for each byte, and the base of the polynomial hash with its inverse modulo 2^64.
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Space, tab, newline, VT, FF and CR.
BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0..n-1 and their inverses, modulo 2^64."""
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()
        for i, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of the result depend on all bits of x."""
    x = x ^ x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Rolling:
    """Hashes of any slices of a byte array in constant time each, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * up[:-1], dtype=np.uint64, out=self.prefix[1:])

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        """``slices`` of ``width`` bytes from every place that has them, in order: no gathers."""
        x = self.prefix[width:] - self.prefix[:-width]
        x *= self.down[: len(x)]
        x += np.uint64(width)
        return mix(x)


#: Bytes over which a slice is hashed by BLAKE2b.
LONG = 256
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice, for telling slices apart: eight bytes a step, mixed after each, so that, unlike in a
    polynomial modulo a power of two, no family of texts (such as the Thue-Morse words) shares a hash by its structure."""
    n = ends - starts
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = mix(n.astype(np.uint64) * np.uint64(BASE) + BYTE[7])
    live, at = np.flatnonzero((n > 0) & (n <= LONG)), 0
    while len(live):
        left = n[live] - at
        out[live] = mix(out[live] * np.uint64(BASE) + (eights[starts[live] + at] & _KEEP[np.minimum(left, 8)]))
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(n > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word, and the first word's index of every document (n+1 of them)."""
    solid = ~BLANK[data]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    before[heads] = False
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after[(tails := offsets[1:] - 1)[tails >= 0]] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    hashes = slice_hashes(LOWER[data] if lower else data, starts, ends)
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``size`` words in a row, sorted within a document, and their offsets (n+1).

    A document with fewer words has all its words as its only shingle; one without words has none.
    """
    n = np.diff(first)
    out, counts = [], np.zeros(len(n), np.int64)
    if len(hashes) >= size:
        run = hashes[: len(hashes) - size + 1].copy()
        for i in range(1, size):
            run = mix(run * np.uint64(BASE) + hashes[i : len(hashes) - size + 1 + i])
    for d in range(len(n)):
        a, m = int(first[d]), int(n[d])
        if not m:
            continue
        if m < size:
            found = np.array([m], np.uint64)
            for i in range(a, a + m):
                found = mix(found * np.uint64(BASE) + hashes[i : i + 1])
        else:
            found = np.sort(run[a : a + m - size + 1])
            found = found[np.concatenate([[True], found[1:] != found[:-1]])]
        counts[d] = len(found)
        out.append(found)
    flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(counts)])
