"""Mergeable heaps: the best k entries of many groups, fed in batches."""

from __future__ import annotations

import numpy as np


def best_rows(group: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k entries of each group, in order: higher scores first, ties by smaller ``tie``."""
    order = np.lexsort((tie, -score, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g, "left") < k]


class Heaps:
    """The best k entries (score, tie, extra) of ``n`` groups.

    Entries are pooled and cut to k a group when the pool has doubled, so its size stays within twice n x k and one batch. ``floor`` is a
    score that a group's new entry must reach to matter.
    """

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.floor = np.full(n, np.iinfo(np.int64).min)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, group: np.ndarray, score: np.ndarray, tie: np.ndarray, extra: np.ndarray) -> None:
        if len(group):
            self.parts.append((group.astype(np.int64), score.astype(np.int64), tie.astype(np.int64), extra.astype(np.int64)))
            self.held += len(group)
            if self.held > 2 * self.n * self.k:
                self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        """Group, score, tie and extra of the entries that stay."""
        if not self.parts:
            return (np.zeros(0, np.int64),) * 4
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        rows = best_rows(*columns[:3], self.k)
        columns = [c[rows] for c in columns]
        full = np.flatnonzero(np.bincount(columns[0], minlength=self.n) >= self.k)
        last = np.searchsorted(columns[0], full, "right") - 1
        self.floor[full] = columns[1][last]
        self.parts, self.held = [tuple(columns)], len(rows)
        return tuple(columns)
