"""Vectorised hashing of words, word shingles and character shingles."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix64(h: np.ndarray) -> np.ndarray:
    """A finalizer with full avalanche on 64-bit values."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def _mix_in(h: np.ndarray, spare: np.ndarray) -> None:
    """``mix64`` in place; ``spare`` is at least as long."""
    t = spare[: len(h)]
    for mult in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        np.right_shift(h, U64(33), out=t)
        h ^= t
        h *= U64(mult)
    np.right_shift(h, U64(33), out=t)
    h ^= t


def rising(h: np.ndarray) -> np.ndarray:
    """The distinct hashes in rising order, by sorting (numpy's own way for these goes through a slower hash table)."""
    h = np.sort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    return h[new]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        p, q = np.full(size, _BASE, np.uint64), np.full(size, _INV, np.uint64)
        p[0] = q[0] = 1
        _powers[:] = [np.cumprod(p), np.cumprod(q)]
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, A-Z lower-cased, and each text's offsets into them.

    A word is a run of bytes other than 0x20 and 0x09-0x0D.  The hash doesn't depend on the position.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    out = np.empty(len(starts), np.uint64)
    i, step = 0, 1 << 19
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + step, "right")))
        hi = int(ends[j - 1])
        p, q = _power(hi - lo + 1)
        acc = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[data[lo:hi]]] * p[: hi - lo], out=acc[1:])
        s = starts[i:j] - lo
        out[i:j] = (acc[ends[i:j] - lo] - acc[s]) * q[s]
        i = j
    return mix64(out), np.searchsorted(starts, offsets).astype(np.int64)


def word_shingles(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words and each text's offsets; a shorter text gives its whole sequence as one."""
    counts = np.diff(offsets)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_offs = np.concatenate([[0], np.cumsum(n)])
    total = int(out_offs[-1])
    row = np.repeat(np.arange(len(counts)), n)
    first = offsets[:-1][row] + np.arange(total) - out_offs[:-1][row]
    take = np.minimum(counts[row], size)
    h = np.full(total, U64(size), np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for k in range(size):
        h = mix64(h * U64(_BASE) + np.where(k < take, padded[first + k], U64(k + 1)))
    return h, out_offs


def char_shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` bytes of each line data[start:end], and offsets; a shorter, nonempty line gives itself."""
    counts = ends - starts
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_offs = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(int(out_offs[-1]), np.uint64)
    whole = bool((counts >= size).all())
    i, step = 0, 1 << 15
    spare = np.empty((2, 0), np.uint64)  # every step works in the same memory
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + step, "right")))
        hi = int(ends[j - 1])
        p, q = _power(hi - lo + 1)
        if spare.shape[1] < hi - lo + 1:
            spare = np.empty((2, max(step, hi - lo) + 1), np.uint64)
        acc, h = spare[0, : hi - lo + 1], spare[1, : hi - lo]
        np.take(_BYTE, data[lo:hi], mode="clip", out=h)
        h *= p[: hi - lo]
        acc[0] = 0
        np.cumsum(h, out=acc[1:])
        if whole:  # every run of the step, of which those stay that lie in a line
            h = h[: hi - lo - size + 1]
            np.subtract(acc[size:], acc[:-size], out=h)
            h *= q[: len(h)]
            if j > i + 1:
                edge = np.zeros(len(h) + 1, np.int8)
                edge[starts[i:j] - lo] += 1
                edge[ends[i:j] - size + 1 - lo] -= 1
                h = h[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
        else:
            total = int(out_offs[j] - out_offs[i])
            first = np.arange(total) + np.repeat(starts[i:j] - lo - (out_offs[i:j] - out_offs[i]), n[i:j])
            last = first + np.repeat(np.minimum(counts[i:j], size), n[i:j])
            h = (acc[last] - acc[first]) * q[first]
        found = out[out_offs[i] : out_offs[j]]
        found[:] = h
        _mix_in(found, spare[0] if len(found) <= spare.shape[1] else np.empty_like(found))
        i = j
    return out, out_offs


def permutations(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of ``k`` permutations of 32-bit values."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, k, dtype=np.uint32)


def minhash(h: np.ndarray, offsets: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """MinHash matrix (texts x permutations, uint32); rows of empty sets hold the largest value."""
    n, k = len(offsets) - 1, len(mult)
    out = np.full((n, k), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if not len(full):
        return out
    h32 = (h >> U64(32)).astype(np.uint32)
    starts = offsets[full]
    ends = offsets[full + 1]
    i = 0
    while i < len(full):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + 32768, "right")))
        part = h32[starts[i] : ends[j - 1]]
        at = starts[i:j] - starts[i]
        rows = full[i:j]
        v, least = np.empty_like(part), np.empty((k, j - i), np.uint32)
        for p in range(k):
            np.multiply(part, mult[p], out=v)
            np.add(v, add[p], out=v)
            np.minimum.reduceat(v, at, out=least[p])
        out[rows] = least.T
        i = j
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of a MinHash matrix (texts x bands, int64)."""
    n = len(sig)
    cells = sig[:, : bands * rows].reshape(n, bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * U64(0xD6E8FEB86659FD93), (n, bands)).copy()
    for r in range(rows):
        h = mix64(h * U64(_BASE) + cells[:, :, r])
    return h.view(np.int64)


def odd_sketch(sig: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps of MinHash samples: sample i with value v flips bit hash(i, v) (texts x bits / 64, uint64)."""
    n, k = sig.shape
    salt = mix64(np.arange(1, k + 1, dtype=np.uint64))
    pos = (mix64(sig.astype(np.uint64) ^ salt[None, :]) % U64(bits)).astype(np.int64)
    flips = np.bincount((pos + np.arange(n)[:, None] * bits).ravel(), minlength=n * bits) & 1
    return np.packbits(flips.astype(np.uint8).reshape(n, bits), axis=1, bitorder="little").view(np.uint64)


def xor_limit(k: int, bits: int, similarity: float, sigmas: float = 5.0) -> int:
    """The most differing sketch bits that a pair of at least that similarity shows, ``sigmas`` deviations out."""
    d = k * (1 - similarity) + sigmas * float(np.sqrt(k * similarity * (1 - similarity)))
    mean = bits / 2 * (1 - (1 - 2 / bits) ** (2 * d))
    return int(np.ceil(mean + sigmas))


def unique_sets(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in rising order, flat, and how many each has."""
    h = h.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[offsets[:-1][np.diff(offsets) > 0]] = True
    return h[new], np.diff(np.concatenate([[0], np.cumsum(new)])[offsets])


def set_prints(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 128-bit print of each set, without regard to order (sets x 2, int64)."""
    out = np.zeros((len(sizes), 2), np.uint64)
    full = np.flatnonzero(sizes > 0)
    if len(full):
        at = np.concatenate([[0], np.cumsum(sizes)])[full]
        out[full, 0] = np.add.reduceat(mix64(flat ^ U64(0xA0761D6478BD642F)), at)
        out[full, 1] = np.add.reduceat(mix64(flat * U64(_BASE) ^ U64(0xE7037ED1A0B428DB)), at)
    return out.view(np.int64)
