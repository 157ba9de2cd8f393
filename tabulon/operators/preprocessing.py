"""Scalers. Fitting is one aggregate; applying is a projection with the fitted numbers as literals, without a shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.literals import double
from tabulon.operators.base import Estimator
from tabulon.plans.features import Features
from tabulon.plans.moments import Extremes, Moments, extremes, moments


class _Scaler(Estimator):
    _state = None

    def fit(self, df: DataFrame, features: str | list[str]):
        """Learns from ``df`` alone."""
        self._features, self._state = None, None
        return self.partial_fit(df, features)

    def partial_fit(self, df: DataFrame, features: str | list[str] | None = None):
        """Adds ``df`` to what has been learnt, by ``fit`` or by earlier calls."""
        found = Features.of(df, features) if self._features is None else self._of(df, features)
        new = self._learn(df, found)
        self._state = new if self._state is None else self._state.merged(new)
        self._features = self._features or found
        return self

    def transform(self, df: DataFrame, features: str | list[str] | None = None, suffix: str = "_scaled") -> DataFrame:
        """``df`` with a scaled column for each feature column (or one scaled array); ``suffix`` "" replaces them."""
        return self._apply(df, self._of(df, features), self._forward(), suffix)

    def fit_transform(self, df: DataFrame, features: str | list[str], suffix: str = "_scaled") -> DataFrame:
        return self.fit(df, features).transform(df, suffix=suffix)

    def inverse_transform(self, df: DataFrame, features: str | list[str] | None = None, suffix: str = "_original") -> DataFrame:
        """Undoes ``transform`` on the columns named (those of fit by default)."""
        return self._apply(df, self._of(df, features), self._backward(), suffix)

    @property
    def n_samples_seen_(self) -> int:
        return 0 if self._state is None else self._state.count

    def _apply(self, df: DataFrame, features: Features, forms: list[str], suffix: str) -> DataFrame:
        values = [f.format(x=f"({e})") for f, e in zip(forms, features.sql())]
        if features.array is not None:
            return df.withColumn(features.array + suffix, F.expr(f"array({', '.join(values)})"))
        return df.withColumns({n + suffix: F.expr(v) for n, v in zip(features.names, values)})

    def _frame(self, spark: SparkSession, columns: dict[str, np.ndarray]) -> DataFrame:
        rows = [(n, *(float(c[j]) for c in columns.values())) for j, n in enumerate(self._fitted().names)]
        return spark.createDataFrame(rows, ", ".join(["feature string", *(f"{c} double" for c in columns)]))


class StandardScaler(_Scaler):
    """(x - mean) / scale, with the variance of all rows; a constant feature has scale 1."""

    def __init__(self, *, with_mean: bool = True, with_std: bool = True, n_jobs: int = 1):
        self.with_mean, self.with_std, self.n_jobs = with_mean, with_std, n_jobs

    def _learn(self, df: DataFrame, features: Features) -> Moments:
        return moments(df, features)

    @property
    def mean_(self) -> np.ndarray | None:
        return None if self._state is None else self._state.mean

    @property
    def var_(self) -> np.ndarray | None:
        return None if self._state is None else self._state.variance

    @property
    def scale_(self) -> np.ndarray | None:
        return None if self._state is None else np.where(self.var_ == 0, 1.0, np.sqrt(self.var_))

    def _forward(self) -> list[str]:
        shift = [f"({{x}} - {double(m)})" if self.with_mean else "{x}" for m in self.mean_]
        return [f"{a} / {double(s)}" if self.with_std else a for a, s in zip(shift, self.scale_)]

    def _backward(self) -> list[str]:
        spread = [f"({{x}} * {double(s)})" if self.with_std else "{x}" for s in self.scale_]
        return [f"{a} + {double(m)}" if self.with_mean else a for a, m in zip(spread, self.mean_)]

    def stats_df(self, spark: SparkSession) -> DataFrame:
        """``feature, mean, var, scale``."""
        self._fitted()
        return self._frame(spark, {"mean": self.mean_, "var": self.var_, "scale": self.scale_})


class MinMaxScaler(_Scaler):
    """Takes each feature's range to ``feature_range``; a constant feature goes to its lower end."""

    def __init__(self, feature_range: tuple[float, float] = (0.0, 1.0), *, clip: bool = False, n_jobs: int = 1):
        if not feature_range[0] < feature_range[1]:
            raise ValueError("feature_range must have its minimum below its maximum")
        self.feature_range, self.clip, self.n_jobs = tuple(feature_range), clip, n_jobs

    def _learn(self, df: DataFrame, features: Features) -> Extremes:
        return extremes(df, features)

    @property
    def data_min_(self) -> np.ndarray | None:
        return None if self._state is None else self._state.low

    @property
    def data_max_(self) -> np.ndarray | None:
        return None if self._state is None else self._state.high

    @property
    def data_range_(self) -> np.ndarray | None:
        return None if self._state is None else self._state.high - self._state.low

    @property
    def scale_(self) -> np.ndarray | None:
        if self._state is None:
            return None
        low, high = self.feature_range
        wide = self.data_range_ > 0
        return np.where(wide, (high - low) / np.where(wide, self.data_range_, 1.0), 0.0)

    @property
    def min_(self) -> np.ndarray | None:
        return None if self._state is None else self.feature_range[0] - self._state.low * self.scale_

    def _forward(self) -> list[str]:
        low, high = map(double, self.feature_range)
        line = [f"({{x}} * {double(s)} + {double(m)})" for s, m in zip(self.scale_, self.min_)]
        return [f"greatest({low}, least({high}, {e}))" for e in line] if self.clip else line

    def _backward(self) -> list[str]:
        return [
            f"({{x}} - {double(m)}) / {double(s)}" if s else f"CASE WHEN {{x}} IS NOT NULL THEN {double(d)} END"
            for s, m, d in zip(self.scale_, self.min_, self.data_min_)
        ]

    def stats_df(self, spark: SparkSession) -> DataFrame:
        """``feature, data_min, data_max, scale, min``."""
        self._fitted()
        return self._frame(spark, {"data_min": self.data_min_, "data_max": self.data_max_, "scale": self.scale_, "min": self.min_})
