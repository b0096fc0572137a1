"""SuperMinHash signatures of shingle sets, and their bands."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 4
#: Prime, so that every step visits all slots; BANDS * ROWS of them are used.
SLOTS = 163
BANDS = 32
ROWS = 5

_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser: a hash of each number."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of all words as one if they are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = min(n, len(words))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        out = mix(out * _M3 + h[i:len(h) - n + 1 + i])
    return np.unique(out)


def tokens(text: bytes | None) -> list[bytes]:
    """Words of the text, A-Z lowered."""
    return (text or b"").lower().split()


def signatures(sets: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """One row of SLOTS values for each non-empty set.

    Each element visits the slots in an order of its own, (a + b j) mod SLOTS,
    and offers the value j + r_j, r_j in [0, 1), to the j-th: its ranks over
    the slots are a permutation.  A slot keeps the smallest offer.  Elements
    of all sets take step j at once; a set stops as soon as its largest value
    is below j + 1, for no later offer can be smaller.
    """
    out = np.empty((len(sets), SLOTS), np.uint64)
    out.fill(np.iinfo(np.uint64).max)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    x = mix(np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64), 7919 * (seed + 1))
    first = (x % np.uint64(SLOTS)).astype(np.int64)
    stride = (x // np.uint64(SLOTS) % np.uint64(SLOTS - 1)).astype(np.int64) + 1
    for j in range(SLOTS):
        if not len(x):
            break
        r = mix(x, j + 1) >> np.uint64(8)
        np.minimum.at(flat, owner * SLOTS + (first + j * stride) % SLOTS, r | np.uint64(j << 56))
        open_ = (out.max(axis=1) >> np.uint64(56)) > j
        if not open_.all():
            keep = open_[owner]
            x, owner, first, stride = x[keep], owner[keep], first[keep], stride[keep]
    return out


def band_keys(sigs: np.ndarray, seed: int = 0) -> np.ndarray:
    """A key for each band of ROWS values; bands of different places never share one."""
    keys = np.empty((len(sigs), BANDS), np.int64)
    for b in range(BANDS):
        k = np.full(len(sigs), np.uint64(b + 1 + 1000 * seed))
        for i in range(b * ROWS, (b + 1) * ROWS):
            k = mix(k * _M3 + sigs[:, i])
        keys[:, b] = k.view(np.int64)
    return keys


def linked(a: np.ndarray, b: np.ndarray, percent: int = 80) -> bool:
    """100 * |a & b| >= percent * |a | b|, exactly."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
