"""Public names."""

from tabulon.operators.cluster import KMeans

__all__ = ["KMeans"]
