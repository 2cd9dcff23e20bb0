"""Mergeable Misra-Gries summaries over 64-bit keys, with a bound on what they may forget."""

from __future__ import annotations

import numpy as np


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and their summed counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[starts], np.diff(np.append(starts, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(counts, starts)


class MisraGries:
    """At most ``capacity`` counters; a count is never more than ``error`` below the truth.

    When counters are too many, all of them fall by the least amount that frees enough. That takes more
    than ``capacity`` times the amount from the mass added, so with a capacity above mass / threshold the
    error stays below the threshold and every key as frequent as the threshold survives. The promise does
    not rest on the mass being known: the error never passes ``threshold`` - 1, and a summary whose mass
    turns out larger than planned grows instead of forgetting. Counts are capped at the threshold, where
    a key is certain, so that a hot key adds no mass.
    """

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.error = capacity, threshold, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._room = max(1024, capacity // 2)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._waiting.append((keys, counts))
        self._room -= len(keys)
        if self._room <= 0:
            self._settle()

    def _settle(self) -> None:
        if self._waiting:
            self.keys, self.counts = counted(np.concatenate([self.keys, *(k for k, _ in self._waiting)]),
                                             np.concatenate([self.counts, *(c for _, c in self._waiting)]))
            np.minimum(self.counts, self.threshold, out=self.counts)
            self._waiting.clear()
        over = len(self.keys) - self.capacity
        if over > 0 and self.error < self.threshold - 1:
            fall = min(int(np.partition(self.counts, over - 1)[over - 1]), self.threshold - 1 - self.error)
            self.error += fall
            self.counts = self.counts - fall
            kept = self.counts > 0
            self.keys, self.counts = self.keys[kept], self.counts[kept]
        self._room = max(1024, self.capacity // 2, len(self.keys) // 2)

    def survivors(self) -> np.ndarray:
        """Ascending keys that may have come ``threshold`` times; none that did is missing."""
        self._settle()
        return self.keys[self.counts + self.error >= self.threshold]
