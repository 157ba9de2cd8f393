"""Exact nearest neighbours with cells that a query can rule out.

A tree of median splits over a bounded sample deals the training rows to leaves; each leaf is known by its rows' count and by a
box (``kd_tree``) or a centre and a radius (``ball_tree``) around all of them. A query's k-th neighbour is no farther than the
farthest points of the nearest leaves that hold k rows together, so it goes only to blocks (runs of leaves) with a leaf that begins before that: one
exchange, no copies to all blocks. A block's task splits its own rows further. The sample shapes the leaves; the result doesn't depend on it.

The driver and every task hold the leaves' bounds: ``MOST_LEAVES`` leaves at most, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.distance import Metric
from tabulon.plans.features import Features
from tabulon.plans.partials import matrix
from tabulon.plans.search import Held
from tabulon.plans.tree import SLACK, Bounds, Route, Splits

MOST_LEAVES = 4096
SAMPLE_ROWS = 65_536
#: Training rows that one task searches, about (at least a leaf), and leaves of the routing tree for so many.
BLOCK_ROWS = 16_384
BLOCK_LEAVES = 4


def sampled(train: DataFrame, features: Features, n: int) -> np.ndarray:
    rows = train.select(features.vector().alias("x"))
    rows = rows.sample(min(1.0, 1.2 * SAMPLE_ROWS / n), seed=1) if n > SAMPLE_ROWS else rows
    return matrix(rows.limit(SAMPLE_ROWS).toArrow().column("x").combine_chunks())


def _bounds(train: DataFrame, features: Features, splits: Splits, sample: np.ndarray, metric: Metric, ball: bool) -> Bounds:
    """One pass over the rows; what comes back is a row for each leaf and feature."""
    p, leaves = features.width, splits.leaves
    own = splits.leaves_of(sample)
    number = np.maximum(np.bincount(own, minlength=leaves), 1)
    center = np.stack([np.bincount(own, weights=sample[:, j], minlength=leaves) for j in range(p)], axis=1) / number[:, None]

    def run(batches):
        low, high = np.full((leaves, p + 1), np.inf), np.full((leaves, p + 1), -np.inf)
        count = np.zeros(leaves, dtype=np.int64)
        for batch in batches:
            x = matrix(batch.column(0))
            if not len(x):
                continue
            at = splits.leaves_of(x)
            count += np.bincount(at, minlength=leaves)
            away = np.zeros(len(x))
            for j in range(p):
                away += np.abs(x[:, j] - center[at, j]) ** metric.p
            wide = np.column_stack([x, away])
            np.minimum.at(low, at, wide)
            np.maximum.at(high, at, wide)
        found = np.flatnonzero(count)
        leaf, feature = np.repeat(found, p + 1), np.tile(np.arange(p + 1), len(found))
        columns = [leaf, feature, np.repeat(count[found], p + 1), low[leaf, feature], high[leaf, feature]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["leaf", "feature", "n", "low", "high"])

    parts = train.select(features.vector().alias("x")).mapInArrow(run, "leaf long, feature long, n long, low double, high double")
    found = parts.groupBy("leaf", "feature").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    count, low, high = np.zeros(leaves, dtype=np.int64), np.zeros((leaves, p + 1)), np.zeros((leaves, p + 1))
    at, j = found["leaf"].to_numpy(), found["feature"].to_numpy()
    count[at], low[at, j], high[at, j] = found["n"], found["low"], found["high"]
    radius = high[:, p] ** (1 / max(metric.p, 1.0)) * (1 + SLACK)
    return Bounds(count, low[:, :p], high[:, :p], center, radius, metric, ball)


def routed(sample: np.ndarray, train: DataFrame, features: Features, n_train: int, metric: Metric, ball: bool, leaf_size: int) -> tuple[Splits, Bounds, np.ndarray]:
    """The routing tree, its leaves' bounds and each leaf's block."""
    splits = Splits.of(sample, max(1, min(MOST_LEAVES, n_train // max(1, leaf_size), -(-n_train * BLOCK_LEAVES // BLOCK_ROWS))))
    bounds = _bounds(train, features, splits, sample, metric, ball)
    # Consecutive leaves lie close together; runs of them make a block.
    block = (np.cumsum(bounds.count) - bounds.count) // BLOCK_ROWS
    return splits, bounds, np.unique(block, return_inverse=True)[1]


def searched(batches, k: int, metric: Metric, leaf_size: int):
    """The nearest of each cell's training rows (``cell, asks, id, x``, sorted so that a cell's training rows come first)."""
    cell, ids, points, held = None, [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cells, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        keys, x = batch.column(2), matrix(batch.column(3))
        change = np.flatnonzero((cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])) + 1
        edges = [0, *change.tolist(), len(cells)]
        for a, b in zip(edges, edges[1:]):
            if cells[a] != cell:
                cell, ids, points, held = cells[a], [], [], None
            if not asks[a]:
                ids.append(keys[a:b])
                points.append(x[a:b].copy())
                continue
            if held is None:
                if not ids:
                    continue
                held = Held(pa.concat_arrays(ids), np.concatenate(points), k, metric, leaf_size)
                ids, points = [], []
            step = max(1, (1 << 20) // k)  # rows sent on at once
            for i in range(a, b, step):
                row, col, power = held.best(x[i : min(b, i + step)])
                columns = [keys.take(pa.array(i + row)), held.ids.take(pa.array(col)), pa.array(power)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "neighbor_id", "power"])


def nearest_in_cells(
    queries, query_features, query_id, train, features, train_id, n_train: int, k: int, metric: Metric, ball: bool, leaf_size: int, sample: np.ndarray | None = None
) -> DataFrame:
    """``query_id, neighbor_id, power``: at least the ``k`` nearest training rows of each query, from the blocks it needs."""
    sample = sampled(train, features, n_train) if sample is None else sample
    splits, bounds, block = routed(sample, train, features, n_train, metric, ball, leaf_size)
    tasks = queries.sparkSession.sparkContext.defaultParallelism
    blocks = int(block.max()) + 1
    copies = max(1, -(-tasks // blocks))  # few blocks: their queries are dealt to several tasks
    neighbor = train.schema[train_id].dataType.simpleString()
    schema = f"cell int, asks boolean, id {neighbor}, x array<double>"

    def store(batches):
        for batch in batches:
            own = np.tile(block[splits.leaves_of(matrix(batch.column(1)))], copies) if batch.num_rows else np.zeros(0, dtype=np.int64)
            part = np.repeat(np.arange(copies), batch.num_rows)
            rows = pa.array(np.tile(np.arange(batch.num_rows), copies))
            columns = [pa.array(own * copies + part, pa.int32()), pa.array(np.zeros(len(own), dtype=bool)), *(c.take(rows) for c in batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "asks", "id", "x"])

    def ask(batches):
        route = Route(splits, bounds, block, k)
        for batch in batches:
            for i in range(0, batch.num_rows, route.step):
                part = batch.slice(i, route.step)
                with np.errstate(all="ignore"):
                    row, own = route.blocks(matrix(part.column(1)))
                cell = own * copies + (i + row) % copies
                columns = [pa.array(cell, pa.int32()), pa.array(np.ones(len(cell), dtype=bool)), *(c.take(pa.array(row)) for c in part.columns)]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "asks", "id", "x"])

    stored = train.select(F.col(train_id).alias("id"), features.vector().alias("x")).mapInArrow(store, schema)
    asking = queries.select(F.col(query_id).cast(neighbor).alias("id"), query_features.vector().alias("x"))
    asked = asking.repartition(tasks).mapInArrow(ask, schema)
    dealt = stored.unionByName(asked).repartitionById(blocks * copies, F.col("cell")).sortWithinPartitions("cell", "asks")
    return dealt.mapInArrow(lambda batches: searched(batches, k, metric, leaf_size), f"query_id {neighbor}, neighbor_id {neighbor}, power double")
