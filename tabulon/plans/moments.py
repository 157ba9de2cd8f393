"""Count, mean, variance and extremes of features, and how two batches' statistics combine."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.plans.features import Features, check_rows
from tabulon.plans.partials import mean_of, merged

#: Up to so many features one SQL aggregate takes them all; beyond, NumPy over Arrow blocks.
SQL_WIDTH = 24


@dataclass(frozen=True)
class Moments:
    """``squares`` are summed squared deviations from ``mean``."""

    count: int
    mean: np.ndarray
    squares: np.ndarray

    @property
    def variance(self) -> np.ndarray:
        """Over all rows, not the sample estimate."""
        return self.squares / self.count

    def merged(self, other: Moments) -> Moments:
        """Statistics of both batches together (pairwise update)."""
        n = self.count + other.count
        gap = other.mean - self.mean
        return Moments(
            n, self.mean + gap * (other.count / n), self.squares + other.squares + gap * gap * (self.count * other.count / n)
        )


@dataclass(frozen=True)
class Extremes:
    count: int
    low: np.ndarray
    high: np.ndarray

    def merged(self, other: Extremes) -> Extremes:
        return Extremes(self.count + other.count, np.minimum(self.low, other.low), np.maximum(self.high, other.high))


def _aggregate(df: DataFrame, features: Features, functions: list[str]):
    exprs = [f"{f}({e}) AS {f}_{j}" for f in functions for j, e in enumerate(features.sql())]
    exprs += ["count(*) AS n", f"count_if({features.bad_sql()}) AS bad"]
    row = df.agg(*(F.expr(e) for e in exprs)).first()
    check_rows(row["n"], row["bad"])
    return row["n"], *(np.array([row[f"{f}_{j}"] for j in range(features.width)], dtype=float) for f in functions)


def _blocks_of(df: DataFrame, features: Features) -> DataFrame:
    """``x``, all features (zeros where a row is bad), and ``bad``, whether it is."""
    bad = F.expr(features.bad_sql())
    return df.select(F.when(bad, F.array_repeat(F.lit(0.0), features.width)).otherwise(features.vector()).alias("x"), bad.alias("bad"))


def _checked(found: np.ndarray | None) -> int:
    """The number of rows, first in a merged vector; what every fit refuses, by the number of bad ones behind it."""
    n, bad = (0, 0) if found is None else (int(found[0]), int(found[1]))
    check_rows(n, bad)
    return n


def moments(df: DataFrame, features: Features) -> Moments:
    """One pass: an aggregate where the features are few, else the moments of Arrow blocks, merged pairwise."""
    features.checked(df)
    if features.width <= SQL_WIDTH:
        n, mean, variance = _aggregate(df, features, ["avg", "var_pop"])
        return Moments(n, mean, variance * n)
    width, rows = features.width, _blocks_of(df, features)

    def packed(m: Moments, broken: float) -> np.ndarray:
        return np.concatenate([[m.count, broken], m.mean, m.squares])

    def unpacked(v: np.ndarray) -> Moments:
        return Moments(v[0], v[2 : 2 + width], v[2 + width :])

    def of_block(block: list[np.ndarray]) -> np.ndarray:
        x, broken = block
        mean = mean_of(x)
        return packed(Moments(len(x), mean, ((x - mean) ** 2).sum(axis=0)), broken.sum())

    found = merged(rows, of_block, lambda a, b: packed(unpacked(a).merged(unpacked(b)), a[1] + b[1]))
    n, whole = _checked(found), unpacked(found)
    return Moments(n, whole.mean, whole.squares)


def extremes(df: DataFrame, features: Features) -> Extremes:
    """One pass, as for ``moments``."""
    features.checked(df)
    if features.width <= SQL_WIDTH:
        return Extremes(*_aggregate(df, features, ["min", "max"]))

    def of_block(block: list[np.ndarray]) -> np.ndarray:
        x, broken = block
        return np.concatenate([[len(x), broken.sum()], x.min(axis=0), -x.max(axis=0)])

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([a[:2] + b[:2], np.minimum(a[2:], b[2:])])

    found = merged(_blocks_of(df, features), of_block, merge)
    n = _checked(found)
    low, high = found[2:].reshape(2, -1) * [[1], [-1]]
    return Extremes(n, low, high)


def exact_median(df: DataFrame, value: str, collected: int = 100_000) -> float:
    """The median of a SQL expression, the mean of the middle two for an even count; bounded memory at any size.

    Up to ``collected`` rows the built-in aggregate does it. Beyond, counts over 1024 equal ranges narrow the range that holds the
    middle until so many values at most are left, which the driver sorts.
    """
    rows = df.select(F.expr(value).alias("v"))
    n, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if n <= collected:
        return float(rows.agg(F.median("v")).first()[0])
    found = []
    for place in {(n - 1) // 2, n // 2}:
        a, b, below = low, high, 0
        while True:
            inside = rows.filter((F.col("v") >= a) & (F.col("v") <= b))
            width = (b - a) / 1024
            if not a + width > a:
                found.append(a)
                break
            at = F.least(F.lit(1023), F.floor((F.col("v") - F.lit(a)) / F.lit(width))).cast("int").alias("at")
            ranges = inside.groupBy(at).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
            for r in sorted(ranges.collect(), key=lambda r: r["at"]):
                if below + r["n"] > place:
                    a, b, left = r["a"], r["b"], r["n"]
                    break
                below += r["n"]
            if a == b:
                found.append(a)
                break
            if left <= collected:
                values = sorted(r["v"] for r in rows.filter((F.col("v") >= a) & (F.col("v") <= b)).collect())
                found.append(values[place - below])
                break
    return float(sum(found) / len(found))
