"""Public names."""

from tabulon.operators.preprocessing import MinMaxScaler, StandardScaler

__all__ = ["MinMaxScaler", "StandardScaler"]
