"""A cuckoo filter over keys of two 64-bit halves, with whole arrays of keys at a time."""

from __future__ import annotations

import numpy as np

SLOTS = 4  # per bucket
LOAD = 0.85  # of the slots, when the filter is full
ROUNDS = 400  # of moving entries before the filter counts as full


class CuckooFilter:
    """Tells which keys are certainly absent.

    An entry is 16 bits of a key's low half; it lies in one of two buckets, each of which follows from
    the other and the entry, so entries can move without their keys, and be removed.
    """

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def from_bytes(cls, content: bytes) -> CuckooFilter:
        return cls(np.frombuffer(content, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @property
    def capacity(self) -> int:
        return int(self.table.size * LOAD)

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table))

    def _place(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entry = (low.view(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        entry[entry == 0] = 1
        return (high.view(np.uint64) & np.uint64(len(self.table) - 1)).astype(np.int64), entry

    def _other(self, bucket: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return bucket ^ ((entry.astype(np.int64) * 0x5BD1E995 >> 7) & (len(self.table) - 1))

    def contains(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        bucket, entry = self._place(high, low)
        wanted = entry[:, None]
        return (self.table[bucket] == wanted).any(axis=1) | (self.table[self._other(bucket, entry)] == wanted).any(axis=1)

    def _fill(self, bucket: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Put entries into free slots of their buckets; which of them found none."""
        left = np.arange(len(bucket))
        for slot in range(SLOTS):
            free = left[self.table[bucket[left], slot] == 0]
            _, first = np.unique(bucket[free], return_index=True)
            put = free[first]
            self.table[bucket[put], slot] = entry[put]
            left = np.setdiff1d(left, put, assume_unique=True)
        return left

    def add(self, high: np.ndarray, low: np.ndarray) -> bool:
        """Insert distinct keys; False if the filter is too small, which leaves it unusable."""
        if len(self) + len(high) > self.capacity:
            return False
        bucket, entry = self._place(high, low)
        left = self._fill(bucket, entry)
        bucket, entry = self._other(bucket[left], entry[left]), entry[left]
        for turn in range(ROUNDS):
            left = self._fill(bucket, entry)
            bucket, entry = bucket[left], entry[left]
            if not len(bucket):
                return True
            # One entry per bucket takes the place of another, which goes on to its other bucket.
            _, first = np.unique(bucket, return_index=True)
            where, slot = bucket[first], turn % SLOTS
            out = self.table[where, slot].copy()
            self.table[where, slot] = entry[first]
            bucket, entry = bucket.copy(), entry.copy()
            entry[first] = out
            bucket[first] = self._other(where, out)
        return False

    def remove(self, high: np.ndarray, low: np.ndarray) -> None:
        """Remove keys that were added."""
        bucket, entry = self._place(high, low)
        bucket, entry = self._clear(bucket, entry)
        self._clear(self._other(bucket, entry), entry)

    def _clear(self, bucket: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take entries out of their buckets; what was not found there."""
        left = np.arange(len(bucket))
        for slot in range(SLOTS):
            found = left[self.table[bucket[left], slot] == entry[left]]
            _, first = np.unique(bucket[found], return_index=True)
            self.table[bucket[found[first]], slot] = 0
            left = np.setdiff1d(left, found[first], assume_unique=True)
        return bucket[left], entry[left]
