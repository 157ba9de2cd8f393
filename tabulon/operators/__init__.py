"""Estimators: objects that are fitted to a DataFrame and applied to others."""

from tabulon.operators.cluster import KMeans
from tabulon.operators.linear_model import HuberRegressor, RidgeRegressor
from tabulon.operators.neighbors import KNeighborsClassifier, KNeighborsRegressor
from tabulon.operators.preprocessing import MinMaxScaler, StandardScaler

__all__ = [
    "HuberRegressor",
    "KMeans",
    "KNeighborsClassifier",
    "KNeighborsRegressor",
    "MinMaxScaler",
    "RidgeRegressor",
    "StandardScaler",
]
