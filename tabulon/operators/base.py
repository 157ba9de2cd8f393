"""What all estimators share."""

from __future__ import annotations

import inspect

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.plans.features import Features, same_width


class Estimator:
    """Keeps constructor parameters under their names and the features seen by fit."""

    _features: Features | None = None

    def get_params(self, deep: bool = True) -> dict:
        """Constructor parameters; ``deep`` makes no difference, as none of them is an estimator."""
        return {n: getattr(self, n) for n in inspect.signature(type(self).__init__).parameters if n != "self"}

    @property
    def n_features_in_(self) -> int | None:
        return None if self._features is None else self._features.width

    def _fitted(self) -> Features:
        if self._features is None:
            raise ValueError("Not fitted yet")
        return self._features

    def _of(self, df: DataFrame, features: str | list[str] | None) -> Features:
        """The features of ``df`` to apply to: those of fit unless others, as many, are named."""
        fitted = self._fitted()
        if features is None:
            return fitted.checked(df)
        found = Features.of(df, features).checked(df)
        same_width(found, fitted.width)
        return found

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self.get_params().items())})"


class Regression(Estimator):
    """Scoring of a ``predict`` that appends a double column."""

    def score(self, df: DataFrame, label: str, features: str | list[str] | None = None) -> float:
        """R squared; where the label is constant 1.0 for a perfect prediction, else 0.0."""
        p, y = F.col("_predicted"), F.col("_label").cast("double")
        rows = self.predict(df.withColumn("_label", F.col(label)), features=features, output="_predicted")
        error, spread, n = rows.agg(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y), F.count(y)).first()
        if not n:
            raise ValueError("X must be non-empty")
        if spread == 0:
            return 1.0 if error == 0 else 0.0
        return 1.0 - error / spread


def as_array(x) -> np.ndarray:
    return np.asarray(x, dtype=float)
