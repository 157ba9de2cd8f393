"""Public names."""

from tabulon.operators.neighbors import KNeighborsClassifier, KNeighborsRegressor

__all__ = ["KNeighborsClassifier", "KNeighborsRegressor"]
