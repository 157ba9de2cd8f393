"""Where rows come from: Parquet tables and in-memory arrays."""

from tabulon.sources.tables import from_arrays, read_table

__all__ = ["from_arrays", "read_table"]
