"""A hierarchical index over 64-bit fingerprints in Gray order, in numpy.

Fingerprints are sorted by Gray rank, in which neighbours share most bits. Consecutive ones form a leaf node, leaf
nodes form upper nodes. A node stores the bits that all below it share: a mask and a pattern; what its parent has
already is factored out. A search goes down level by level with the differences added up so far, and drops whole
groups as soon as these exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN_OUT = 8
#: Pairs of query and node that one block of a search holds.
BLOCK = 1 << 20


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each uint64 in the reflected Gray code."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def _shared(values: np.ndarray, masks: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask and pattern of the bits on which the values of each group agree, among those in all of its masks."""
    ones, zeros = np.bitwise_and.reduceat(values, starts), np.bitwise_or.reduceat(values, starts)
    mask = np.bitwise_and.reduceat(masks, starts) & ~(ones ^ zeros)
    return mask, ones & mask


class GrayIndex:
    """Over groups: each has a root of its own, and a search stays below the root that it starts from.

    values: uint64, sorted by (group, gray_rank). groups: the group of each value, ascending from 0 without gaps.
    """

    def __init__(self, values: np.ndarray, groups: np.ndarray) -> None:
        self.values = values
        full = np.full(len(values), ~np.uint64(0))
        at, masks, patterns = groups, full, values
        levels = []  # from the leaves up: mask, pattern, first and last child
        while True:
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            sizes = np.diff(np.r_[first, len(at)])
            within = np.arange(len(at)) - np.repeat(first, sizes)
            starts = np.flatnonzero(within % FAN_OUT == 0)
            mask, pattern = _shared(patterns, masks, starts)
            levels.append((mask, pattern, starts, np.r_[starts[1:], len(at)]))
            at, masks, patterns = at[starts], mask, pattern
            if len(starts) == len(first):
                break
        self.levels = levels[::-1]

    def pairs(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query's place, value's place) of all values within `radius` bits below the query's root, in blocks."""
        todo = [(0, np.arange(len(queries)), roots, np.zeros(len(queries), np.uint8))]
        while todo:
            depth, q, node, so_far = todo.pop()
            if len(q) > BLOCK:
                half = len(q) // 2
                todo += [(depth, q[half:], node[half:], so_far[half:]), (depth, q[:half], node[:half], so_far[:half])]
                continue
            if depth == len(self.levels):
                keep = np.bitwise_count(queries[q] ^ self.values[node]) <= radius
                yield q[keep], node[keep]
                continue
            mask, pattern, first, last = self.levels[depth]
            own = mask[node]
            if depth:  # the parent's share of the differences is in so_far
                own = own & ~self._above[depth][node]
            so_far = so_far + np.bitwise_count((queries[q] ^ pattern[node]) & own)
            keep = so_far <= radius
            q, node, so_far = q[keep], node[keep], so_far[keep]
            sizes = last[node] - first[node]
            child = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[node], sizes)
            todo.append((depth + 1, np.repeat(q, sizes), child, np.repeat(so_far, sizes)))

    @property
    def _above(self) -> list[np.ndarray]:
        """By level, the mask of each node's parent."""
        if not hasattr(self, "_parents"):
            self._parents = [np.empty(0, np.uint64)]
            for mask, _, first, last in self.levels[:-1]:
                self._parents.append(np.repeat(mask, last - first))
        return self._parents


def forest(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """labels, with those of linked places lowered to the least label that each reaches over these pairs."""
    while len(a):
        low = np.minimum(labels[a], labels[b])
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
        left = labels[a] != labels[b]
        a, b = a[left], b[left]
    return labels
