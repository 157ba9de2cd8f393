"""Sums and merges over all rows of what NumPy computes from blocks of them.

Each task turns its rows into one vector. Vectors are added up by position in a Spark aggregation, so the driver receives one
vector whatever the number of tasks; those that merge in another way do so in a few tasks more, whose results the driver merges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that merge the vectors of all others.
MERGERS = 8
#: Numbers (tasks times a vector's) up to which the driver adds up the tasks' vectors itself: at most 8 MB, one stage less a round.
DRIVER_CELLS = 1 << 20


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an array<double> column as a 2-D array."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of each non-empty batch: arrays as matrices, others as vectors."""
    for batch in batches:
        if batch.num_rows:
            yield [matrix(c) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]


def mean_of(x: np.ndarray) -> np.ndarray:
    """Means of a block's columns, by way of its first row: a constant column gives its value exactly."""
    return x[0] + (x - x[0]).mean(axis=0)


def summed(df: DataFrame, vector: Callable[[list[np.ndarray]], np.ndarray], size: int) -> np.ndarray:
    """The sum over all blocks of ``vector`` (``size`` numbers each)."""

    def run(batches):
        out, any_rows = np.zeros(size), False
        for columns in blocks(batches):
            out += vector(columns)
            any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([out])], ["part"])

    return added(df.mapInArrow(run, "part array<double>"), size)


def added(parts: DataFrame, size: int, tasks: int | None = None) -> np.ndarray:
    """The sum of all ``part`` (``size`` numbers each). The driver adds them up where that many ``tasks`` give few numbers, else Spark."""
    out = np.zeros(size)
    if tasks is not None and tasks * size <= DRIVER_CELLS:
        for row in parts.collect():  # a row a task, in their order
            out += row["part"]
        return out
    for row in parts.select(F.posexplode("part").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[row["at"]] = row["x"]
    return out


def merged(df: DataFrame, vector: Callable[[list[np.ndarray]], np.ndarray], merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """What ``merge`` makes of the vectors of all blocks, in any order; None without rows. One pass over ``df``."""

    either = lambda a, b: b if a is None else merge(a, b)

    def folded(vectors):
        found = reduce(either, vectors, None)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([found])], ["part"])

    def run(batches):
        return folded(vector(columns) for columns in blocks(batches))

    def again(batches):
        return folded(part for columns in blocks(batches) for part in columns[0])

    parts = df.mapInArrow(run, "part array<double>").repartition(MERGERS).mapInArrow(again, "part array<double>")
    return reduce(either, (np.array(row["part"]) for row in parts.collect()), None)
