"""A minimal perfect hash over a fixed set of byte strings.

Hash and displace: keys fall into buckets by the high bits of a 64-bit hash;
for each bucket, largest first, a pilot is searched with which all its keys
land on free slots of the table, which has exactly as many slots as keys.
Buckets of one key name a free slot directly. A look-up is one hash, one pilot
and one comparison with the key kept in the slot, so a string that is not a key
is told apart exactly.
"""

from __future__ import annotations

import numpy as np
import xxhash

_MASK = (1 << 64) - 1
#: Odd multipliers (from the golden ratio and the square root of 3).
_A, _B = 0x9E3779B97F4A7C15, 0xBB67AE8584CAA73B
_PER_BUCKET = 4
_TRIES = 64


def hash64(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


class PerfectHash:
    """slot(key) is a different number below len(keys) for each key."""

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, self.n // _PER_BUCKET)
        hashes = np.fromiter((hash64(k) for k in keys), np.uint64, self.n)
        if len(np.unique(hashes)) != self.n:
            raise ValueError("equal keys, or keys with equal hashes")
        pilots = self._search(hashes)
        self.pilots: list[int] = pilots.tolist()
        self.keys: list[bytes] = [b""] * self.n
        self.order: list[int] = [0] * self.n
        for i, k in enumerate(keys):
            at = self.slot(k)
            self.keys[at], self.order[at] = k, i

    def _search(self, hashes: np.ndarray) -> np.ndarray:
        bucket = ((hashes >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)
        by = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket.astype(np.int64), minlength=self.buckets)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        taken, pilots = np.zeros(self.n, bool), np.zeros(self.buckets, np.int64)
        order = np.argsort(-sizes, kind="stable")
        for b in order[sizes[order] > 1]:
            own, first = hashes[by[starts[b] : starts[b + 1]]], 0
            while True:
                tries = np.arange(first, first + _TRIES, dtype=np.uint64)
                at = self._place(own[None, :], tries[:, None])
                apart = np.sort(at, axis=1)
                fits = ~taken[at].any(axis=1) & (np.diff(apart.astype(np.int64), axis=1) > 0).all(axis=1)
                if fits.any():
                    k = int(fits.argmax())
                    pilots[b] = first + k
                    taken[at[k]] = True
                    break
                first += _TRIES
        single = order[sizes[order] == 1]
        pilots[single] = -1 - np.flatnonzero(~taken)[: len(single)]
        return pilots

    def _place(self, h: np.ndarray, pilot: np.ndarray) -> np.ndarray:
        mixed = (h ^ (pilot * np.uint64(_A))) * np.uint64(_B)
        return (((mixed >> np.uint64(32)) * np.uint64(self.n)) >> np.uint64(32)).astype(np.int64)

    def slot(self, key: bytes) -> int:
        h = hash64(key)
        pilot = self.pilots[((h >> 32) * self.buckets) >> 32]
        if pilot < 0:
            return -1 - pilot
        mixed = ((h ^ (pilot * _A & _MASK)) * _B) & _MASK
        return ((mixed >> 32) * self.n) >> 32

    def find(self, key: bytes) -> int:
        """The number of the key in the list given, -1 if it is not in it."""
        if not self.n:
            return -1
        at = self.slot(key)
        return self.order[at] if self.keys[at] == key else -1
