"""Trees of median splits and what is known of their leaves: which of them may hold a query's nearest rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tabulon.functions.distance import Metric

#: Bounds are widened by this share, more than rounding can take off.
SLACK = 1e-9


@dataclass
class Splits:
    """A binary tree: node i has an axis and a threshold and the children 2i + 1 and 2i + 2; axis -1 marks a leaf."""

    axis: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    leaves: int

    @classmethod
    def of(cls, sample: np.ndarray, leaves: int) -> Splits:
        depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        axis, threshold = np.full((2 << depth) - 1, -1), np.zeros((2 << depth) - 1)
        leaf, count = np.zeros((2 << depth) - 1, dtype=np.int64), 0
        stack = [(0, 0, sample)]
        while stack:
            node, level, own = stack.pop()
            wide = np.ptp(own, axis=0) if len(own) else np.zeros(sample.shape[1])
            if level == depth or not wide.any():
                leaf[node], count = count, count + 1
                continue
            axis[node] = int(np.argmax(wide))
            values = own[:, axis[node]]
            threshold[node] = np.median(values)
            right = values > threshold[node]
            if not right.any():  # more than half of the values are the largest one
                right = values == values.max()
                threshold[node] = values[~right].max()
            stack += [(2 * node + 2, level + 1, own[right]), (2 * node + 1, level + 1, own[~right])]
        return cls(axis, threshold, leaf, count)

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.axis[at] >= 0)
            if not len(inner):
                return self.leaf[at]
            own = at[inner]
            at[inner] = 2 * own + 1 + (x[inner, self.axis[own]] > self.threshold[own])


@dataclass
class Bounds:
    """What is known of each leaf: rows, a box, and (for balls) a centre and a radius."""

    count: np.ndarray
    low: np.ndarray
    high: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    metric: Metric
    ball: bool

    def of(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Power sums (a row a query, a column a leaf) that no row of the leaf is below, and none above."""
        if self.ball:
            root = max(self.metric.p, 1.0)  # below order 1 the power sums themselves obey the triangle inequality
            d = self.metric.powers(q, self.center) ** (1 / root)
            return np.maximum(d - self.radius, 0) ** root * (1 - SLACK), ((d + self.radius) ** root) * (1 + SLACK)
        least, most = np.zeros((len(q), len(self.count))), np.zeros((len(q), len(self.count)))
        for j in range(q.shape[1]):
            below, above = self.low[None, :, j] - q[:, j, None], q[:, j, None] - self.high[None, :, j]
            least += self.metric.power(np.maximum(np.maximum(below, above), 0))
            most += self.metric.power(np.maximum(np.abs(below), np.abs(above)))
        return least * (1 - SLACK), most * (1 + SLACK)

    def needed(self, q: np.ndarray, k: int) -> np.ndarray:
        """Which leaves may hold one of the ``k`` nearest rows of each query."""
        least, most = self.of(q)
        whole = self.count >= k
        if whole.any():  # the nearest leaf that holds k rows by itself
            return (least <= most[:, whole].min(axis=1)[:, None]) & (self.count > 0)
        order = np.argsort(most, axis=1)
        held = np.cumsum(self.count[order], axis=1) >= k
        enough = np.where(held.any(axis=1), held.argmax(axis=1), len(self.count) - 1)
        reach = np.take_along_axis(most, order, axis=1)[np.arange(len(q)), enough]
        return (least <= reach[:, None]) & (self.count > 0)

    def paired(self, q: np.ndarray, row: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``of`` for pairs of a row of ``q`` and a leaf, one feature at a time."""
        least, most = np.zeros(len(row)), np.zeros(len(row))
        if self.ball:
            for j in range(q.shape[1]):
                most += self.metric.power(np.abs(q[row, j] - self.center[leaf, j]))
            root = max(self.metric.p, 1.0)
            d = most ** (1 / root)
            return np.maximum(d - self.radius[leaf], 0) ** root * (1 - SLACK), (d + self.radius[leaf]) ** root * (1 + SLACK)
        for j in range(q.shape[1]):
            x = q[row, j]
            below, above = self.low[leaf, j] - x, x - self.high[leaf, j]
            least += self.metric.power(np.maximum(np.maximum(below, above), 0))
            most += self.metric.power(np.maximum(np.abs(below), np.abs(above)))
        return least * (1 - SLACK), most * (1 + SLACK)

    def boxed(self, starts: np.ndarray) -> Bounds:
        """Boxes around runs of leaves that begin at ``starts``."""
        full = self.count[:, None] > 0
        low = np.minimum.reduceat(np.where(full, self.low, np.inf), starts, axis=0)
        high = np.maximum.reduceat(np.where(full, self.high, -np.inf), starts, axis=0)
        return Bounds(np.add.reduceat(self.count, starts), low, high, low[:, :0], low[:, :0], self.metric, False)

    @classmethod
    def around(cls, x: np.ndarray, at: np.ndarray, leaves: int, metric: Metric) -> Bounds:
        """Boxes around rows ``x`` in leaves ``at``."""
        low, high = np.full((leaves, x.shape[1]), np.inf), np.full((leaves, x.shape[1]), -np.inf)
        np.minimum.at(low, at, x)
        np.maximum.at(high, at, x)
        none = np.zeros((leaves, 0))
        return cls(np.bincount(at, minlength=leaves), low, high, none, none, metric, False)


class Route:
    """Which blocks (runs of leaves) may hold one of the ``k`` nearest rows, by groups of blocks, then blocks, then leaves.

    The leaf that a query falls into tells how far its neighbours lie at most; the work for a query is far less than the number of leaves.
    """

    SPAN = 32

    def __init__(self, splits: Splits, bounds: Bounds, block: np.ndarray, k: int):
        self._splits, self._bounds, self._k = splits, bounds, k
        self._starts = np.flatnonzero(np.diff(block, prepend=-1))
        self._ends = np.append(self._starts[1:], len(block))
        self._blocks = bounds.boxed(self._starts)
        self._groups = self._blocks.boxed(np.arange(0, len(self._starts), self.SPAN))
        self.step = max(1, (1 << 18) // len(block))

    def blocks(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``q``, block) for at most ``step`` rows."""
        own = self._splits.leaves_of(q)
        reach = self._bounds.paired(q, np.arange(len(q)), own)[1]
        lone = np.flatnonzero(self._bounds.count[own] < self._k)  # several leaves hold k rows together
        needed = np.logical_or.reduceat(self._bounds.needed(q[lone], self._k), self._starts, axis=1) if len(lone) else np.zeros((0, 1))
        row2, block2 = np.nonzero(needed)
        reach[lone] = -1
        row, group = np.nonzero(self._groups.of(q)[0] <= reach[:, None])
        first = group * self.SPAN
        row, block = _expanded(row, first, np.minimum(first + self.SPAN, len(self._starts)))
        keep = self._blocks.paired(q, row, block)[0] <= reach[row]
        row, block = row[keep], block[keep]
        at, leaf = _expanded(np.arange(len(row)), self._starts[block], self._ends[block])
        keep = (self._bounds.paired(q, row[at], leaf)[0] <= reach[row[at]]) & (self._bounds.count[leaf] > 0)
        at = np.unique(at[keep])
        return np.concatenate([row[at], lone[row2]]), np.concatenate([block[at], block2])


def _expanded(row: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``row`` with all numbers from its first to its end."""
    size = end - first
    return np.repeat(row, size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
