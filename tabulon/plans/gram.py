"""Weighted products of features with each other and with a target, and the ridge system they make."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.literals import double
from tabulon.plans.features import Features, check_rows
from tabulon.plans.partials import mean_of, merged, summed

#: Up to so many features one SQL aggregate has all products; beyond, NumPy over Arrow blocks.
SQL_WIDTH = 12


def centred_products(df: DataFrame, x: list[str], y: str, x_mean: np.ndarray, y_mean: float, weight: str | None = None):
    """(X'WX, X'Wy) for X and y less their means; ``x``, ``y`` and ``weight`` are SQL expressions over ``df``."""
    p = len(x)
    cx = [f"({e} - {double(m)})" for e, m in zip(x, x_mean)]
    cy, w = f"({y} - {double(y_mean)})", f"({weight}) * " if weight else ""
    if p <= SQL_WIDTH:
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        exprs = [f"sum({w}{cx[i]} * {cx[j]})" for i, j in pairs] + [f"sum({w}{c} * {cy})" for c in cx]
        row = df.agg(*(F.expr(e).alias(f"s{k}") for k, e in enumerate(exprs))).first()
        gram, moment = np.zeros((p, p)), np.array(row[len(pairs) :], dtype=float)
        for (i, j), v in zip(pairs, row):
            gram[i, j] = gram[j, i] = v
        return gram, moment
    columns = [F.array(*(F.expr(e) for e in cx)).alias("x"), F.expr(cy).alias("y"), F.expr(weight or "1.0D").alias("w")]

    def products(block: list[np.ndarray]) -> np.ndarray:
        a, b, c = block
        weighted = a * c[:, None]
        return np.concatenate([(weighted.T @ a).ravel(), weighted.T @ b])

    flat = summed(df.select(*columns), products, p * p + p)
    return flat[: p * p].reshape(p, p), flat[p * p :]


def means_and_products(df: DataFrame, features: Features, y: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and products of centred columns, of all features and then ``y``; one pass over Arrow blocks, merged pairwise."""
    q, bad = features.width + 1, f"({features.bad_sql()}) OR {y} IS NULL OR isnan({y})"
    whole = F.concat(features.vector(), F.array(F.expr(y)))
    rows = df.select(F.when(F.expr(bad), F.array_repeat(F.lit(0.0), q)).otherwise(whole).alias("z"), F.expr(bad).alias("bad"))

    def of_block(block: list[np.ndarray]) -> np.ndarray:
        z, broken = block
        mean = mean_of(z)
        centred = z - mean
        return np.concatenate([[len(z), broken.sum()], mean, (centred.T @ centred).ravel()])

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, gap = a[0] + b[0], b[2 : 2 + q] - a[2 : 2 + q]
        products = a[2 + q :] + b[2 + q :] + np.outer(gap, gap).ravel() * (a[0] * b[0] / n)
        return np.concatenate([a[:2] + b[:2], a[2 : 2 + q] + gap * (b[0] / n), products])

    found = merged(rows, of_block, merge)
    check_rows(*((0, 0) if found is None else (int(found[0]), int(found[1]))))
    return int(found[0]), found[2 : 2 + q], found[2 + q :].reshape(q, q)


def solve_ridge(gram: np.ndarray, moment: np.ndarray, alpha: float, failure: str) -> np.ndarray:
    """Coefficients of (gram + alpha I) w = moment."""
    try:
        found = np.linalg.solve(gram + alpha * np.eye(len(moment)), moment)
    except np.linalg.LinAlgError:
        raise ValueError(failure) from None
    if not np.isfinite(found).all():
        raise ValueError(failure)
    return found
