"""Readers. Everything else in the package takes DataFrames and never touches files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def from_arrays(spark: SparkSession, x, y=None, id_col: str = "id", label: str = "y") -> DataFrame:
    """Columns x0, x1, ... of a dense matrix, the label ``y`` if given, and each row's position as ``id_col``."""
    x = np.asarray(x, dtype=np.float64)
    columns = {id_col: pa.array(np.arange(len(x)))} | {f"x{j}": pa.array(x[:, j]) for j in range(x.shape[1])}
    if y is not None:
        columns[label] = pa.array(np.asarray(y))
    return spark.createDataFrame(pa.table(columns))
