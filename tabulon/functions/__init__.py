"""Scalar building blocks: SQL expressions of distances and the reproducible generator."""
