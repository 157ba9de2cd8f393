"""Public names."""

from tabulon.operators.linear_model import HuberRegressor, RidgeRegressor

Ridge, Huber = RidgeRegressor, HuberRegressor

__all__ = ["Huber", "HuberRegressor", "Ridge", "RidgeRegressor"]
