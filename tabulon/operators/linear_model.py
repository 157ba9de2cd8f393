"""Ridge and Huber regression. The driver solves systems the size of the features; all sums over rows are aggregates."""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.literals import double, quoted, total
from tabulon.operators.base import Regression
from tabulon.plans.features import Features, check_rows
from tabulon.plans.gram import SQL_WIDTH, centred_products, means_and_products, solve_ridge
from tabulon.plans.moments import exact_median

log = logging.getLogger(__name__)


class _Linear(Regression):
    coef_: np.ndarray | None = None
    intercept_: float | None = None

    def predict(self, df: DataFrame, features: str | list[str] | None = None, output: str = "prediction") -> DataFrame:
        """``df`` with X.w + b."""
        found = self._of(df, features)
        return df.withColumn(output, self._line(found))

    def _line(self, features: Features) -> Column:
        if features.array is not None and features.width > 16:
            weights = F.array(*(F.lit(float(w)) for w in self.coef_))
            products = F.zip_with(features.vector(), weights, lambda a, b: a * b)
            return F.aggregate(products, F.lit(0.0), lambda a, b: a + b) + F.lit(float(self.intercept_))
        terms = [f"{e} * {double(w)}" for e, w in zip(features.sql(), self.coef_)]
        return F.expr(f"({total(terms)}) + {double(self.intercept_)}")

    def _centre(self, df: DataFrame, features: Features, label: str) -> tuple[int, np.ndarray, float]:
        """Row count and plain means (zeros without an intercept)."""
        features.checked(df)
        y = f"CAST({quoted(label)} AS DOUBLE)"
        exprs = [f"avg({e})" for e in (*features.sql(), y)]
        bad = f"({features.bad_sql()}) OR {y} IS NULL OR isnan({y})"
        row = df.agg(*(F.expr(e) for e in exprs), F.count("*"), F.expr(f"count_if({bad})")).first()
        check_rows(row[-2], row[-1])
        if not self.fit_intercept:
            return row[-2], np.zeros(features.width), 0.0
        return row[-2], np.array(row[: features.width], dtype=float), float(row[features.width])


class RidgeRegressor(_Linear):
    """Least squares with an L2 penalty that leaves the intercept alone. ``solver`` is kept, the system is solved directly."""

    n_samples_fit_: int | None = None

    def __init__(self, *, alpha: float = 1.0, fit_intercept: bool = True, solver: str = "auto"):
        if alpha < 0:
            raise ValueError("alpha must be >= 0")
        if solver not in ("auto", "cholesky"):
            raise ValueError("solver must be 'auto' or 'cholesky'")
        self.alpha, self.fit_intercept, self.solver = alpha, fit_intercept, solver

    def fit(self, df: DataFrame, features: str | list[str], label: str) -> RidgeRegressor:
        """Few features take two aggregates, means and then products of centred columns; more take one pass over blocks."""
        found = Features.of(df, features)
        y = f"CAST({quoted(label)} AS DOUBLE)"
        if found.width > SQL_WIDTH:
            n, mean, products = means_and_products(df, found.checked(df), y)
            if not self.fit_intercept:
                products, mean = products + n * np.outer(mean, mean), np.zeros_like(mean)
            x_mean, y_mean, gram, moment = mean[:-1], float(mean[-1]), products[:-1, :-1], products[:-1, -1]
        else:
            n, x_mean, y_mean = self._centre(df, found, label)
            gram, moment = centred_products(df, found.sql(), y, x_mean, y_mean)
        self.coef_ = solve_ridge(gram, moment, self.alpha, "Solve failed")
        self.intercept_ = float(y_mean - x_mean @ self.coef_) if self.fit_intercept else 0.0
        self._features, self.n_samples_fit_ = found, n
        return self


class HuberRegressor(_Linear):
    """Robust regression by reweighted least squares.

    Weights come from the residuals and scale before them, the scale from the residuals after; the intercept follows from
    plain means. Each round is two aggregates over a persisted projection: weighted products, then the loss.
    """

    # The ratio of a normal's median absolute deviation to its scale, floors, and the scale's least divisor.
    MAD_TO_SCALE = 0.6745
    SCALE_FLOOR = 1e-10
    LEAST_DIVISOR = 0.1

    scale_: float | None = None
    n_iter_: int | None = None

    def __init__(self, *, epsilon: float = 1.35, max_iter: int = 100, alpha: float = 1e-4, fit_intercept: bool = True, tol: float = 1e-5):
        for broken, message in (
            (not epsilon > 1.0, "epsilon must be greater than 1.0"),
            (alpha < 0, "alpha must be >= 0"),
            (max_iter <= 0, "max_iter must be > 0"),
            (not tol > 0, "tol must be > 0"),
        ):
            if broken:
                raise ValueError(message)
        self.epsilon, self.max_iter, self.alpha, self.fit_intercept, self.tol = epsilon, max_iter, alpha, fit_intercept, tol

    def fit(self, df: DataFrame, features: str | list[str], label: str) -> HuberRegressor:
        found = Features.of(df, features)
        n, x_mean, y_mean = self._centre(df, found, label)
        names = [f"x{j}" for j in range(found.width)]
        centred = [f"{e} - {double(m)} AS {c}" for e, m, c in zip(found.sql(), x_mean, names)]
        rows = df.selectExpr(*centred, f"CAST({quoted(label)} AS DOUBLE) - {double(y_mean)} AS y").persist()
        try:
            self._iterate(rows, names, n)
        finally:
            rows.unpersist()
        self.intercept_ = float(y_mean - x_mean @ self.coef_) if self.fit_intercept else 0.0
        self._features = found
        return self

    def _iterate(self, rows: DataFrame, names: list[str], n: int) -> None:
        zeros = np.zeros(len(names))
        residual = lambda w: f"(y - ({total([f'{c} * {double(v)}' for c, v in zip(names, w)])}))"
        w = solve_ridge(*centred_products(rows, names, "y", zeros, 0.0), self.alpha, "Initial solve failed")
        scale = exact_median(rows, f"abs({residual(w)})") / self.MAD_TO_SCALE
        if scale < self.SCALE_FLOOR:
            scale = 1.0
        divisor = n * max(2 * self.epsilon**2 - 1, self.LEAST_DIVISOR)
        for self.n_iter_ in range(1, self.max_iter + 1):
            size, edge = f"abs({residual(w)})", double(self.epsilon * scale)
            weight = f"(CASE WHEN {size} <= {edge} THEN 1.0D ELSE {edge} / {size} END)"
            new = solve_ridge(*centred_products(rows, names, "y", zeros, 0.0, weight), self.alpha, "Weighted solve failed")
            change, w = float(np.max(np.abs(new - w), initial=0.0)), new
            r = residual(w)
            loss = f"sum(CASE WHEN abs({r}) <= {edge} THEN 0.5D * {r} * {r} ELSE {edge} * abs({r}) - 0.5D * {edge} * {edge} END)"
            scale = max(float(np.sqrt(2 * rows.agg(F.expr(loss)).first()[0] / divisor)), self.SCALE_FLOOR)
            if change < self.tol:
                break
        else:
            log.info("stopped after %d rounds, before coefficients changed by less than %g", self.max_iter, self.tol)
        self.coef_, self.scale_ = w, scale
