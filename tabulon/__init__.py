"""Spark-native estimators and data operators."""

from tabulon.operators import (
    HuberRegressor,
    KMeans,
    KNeighborsClassifier,
    KNeighborsRegressor,
    MinMaxScaler,
    RidgeRegressor,
    StandardScaler,
)

__version__ = "0.1.0"
__all__ = [
    "HuberRegressor",
    "KMeans",
    "KNeighborsClassifier",
    "KNeighborsRegressor",
    "MinMaxScaler",
    "RidgeRegressor",
    "StandardScaler",
]
