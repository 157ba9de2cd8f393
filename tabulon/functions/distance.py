"""Distances between two points, as SQL text over columns and as NumPy over blocks.

All forms take direct differences, never the expansion of the square, so that equal points are at distance 0 exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tabulon.functions.literals import double, total

METRICS = ("euclidean", "manhattan", "minkowski")


@dataclass(frozen=True)
class Metric:
    """Minkowski distance of order ``p``. Neighbours are ranked by the power sum; its root is taken of survivors only."""

    p: float

    @classmethod
    def of(cls, name: str, p: float = 2.0) -> Metric:
        if name not in METRICS:
            raise ValueError(f"metric must be one of {', '.join(METRICS)}")
        if name == "minkowski" and not p > 0:
            raise ValueError("p must be > 0")
        return cls({"euclidean": 2.0, "manhattan": 1.0}.get(name, float(p)))

    def power_sql(self, a: list[str], b: list[str]) -> str:
        """The power sum of two points given by one SQL expression a dimension."""
        if self.p == 2:
            return total([f"(({x}) - ({y})) * (({x}) - ({y}))" for x, y in zip(a, b)])
        if self.p == 1:
            return total([f"abs(({x}) - ({y}))" for x, y in zip(a, b)])
        return total([f"pow(abs(({x}) - ({y})), {double(self.p)})" for x, y in zip(a, b)])

    def root_sql(self, power: str) -> str:
        """The distance from its power sum."""
        if self.p == 2:
            return f"sqrt({power})"
        return power if self.p == 1 else f"pow({power}, {double(1 / self.p)})"

    def power(self, gap: np.ndarray) -> np.ndarray:
        """Each non-negative gap to the power of the order."""
        return gap * gap if self.p == 2 else gap if self.p == 1 else gap**self.p

    def powers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Power sums of all rows of ``a`` against all rows of ``b``, one dimension at a time."""
        out = np.zeros((len(a), len(b)))
        for j in range(a.shape[1]):
            out += self.power(np.abs(a[:, j, None] - b[None, :, j]))
        return out

    def paired(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Power sums of each row of ``a`` and the same row of ``b``, added up as ``powers`` does."""
        out = np.zeros(len(a))
        for j in range(a.shape[1]):
            out += self.power(np.abs(a[:, j] - b[:, j]))
        return out
