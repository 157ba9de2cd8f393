"""Shared by the estimators' tests."""

import numpy as np

from tabulon.sources import from_arrays


def names(x):
    return [f"x{j}" for j in range(np.shape(x)[1])]


def frame(spark, x, y=None):
    return from_arrays(spark, x, y)


def values(df, columns, order="id"):
    rows = df.orderBy(order).select(*columns).collect()
    return np.array([list(r) for r in rows], dtype=float)
