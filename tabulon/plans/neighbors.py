"""Exact nearest neighbours of every query row, ties to the smaller id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.distance import Metric
from tabulon.plans.cells import nearest_in_cells, sampled, searched
from tabulon.plans.features import Features
from tabulon.plans.partials import matrix
from tabulon.plans.search import Held, first_of_equal

#: Training rows (of few features, without more than k equal ones) up to which every task holds them all.
BROADCAST_ROWS = 1 << 14
#: ``auto`` takes cells beyond so many training rows, for so few features (in more, cells rule little out).
TREE_ROWS, TREE_WIDTH = 1 << 17, 15
#: Training and query rows that meet in one task otherwise.
BLOCK_ROWS = 32_768


def nearest(
    queries: DataFrame,
    query_features: Features,
    query_id: str,
    train: DataFrame,
    features: Features,
    train_id: str,
    n_train: int,
    k: int,
    metric: Metric,
    algorithm: str = "auto",
    leaf_size: int = 30,
) -> DataFrame:
    """``query_id, rank, neighbor_id, distance``; ranks start at 1. Every ``algorithm`` finds the same rows."""
    narrow = features.width <= TREE_WIDTH
    if algorithm == "auto":
        algorithm = "kd_tree" if n_train > TREE_ROWS and narrow else "brute"
    sides = (queries, query_features, query_id)
    sample, whole = None, n_train
    if narrow and n_train > BROADCAST_ROWS:
        sample = sampled(train, features, n_train)
        if len(first_of_equal(sample, 1)) < len(sample):
            train, whole = _without_copies(train, features, train_id, k), None
    if narrow and (whole is None or whole <= BROADCAST_ROWS):
        few = train.select(F.col(train_id).alias("id"), features.vector().alias("x")).limit(BROADCAST_ROWS + 1).toArrow()
        if len(few) <= BROADCAST_ROWS:
            return _by_broadcast(*sides, few, train.schema[train_id].dataType.simpleString(), k, metric, algorithm != "brute", leaf_size)
        whole = train.count()
    sides = (*sides, train, features, train_id, whole, k, metric)
    if algorithm != "brute":
        found = nearest_in_cells(*sides, algorithm == "ball_tree", leaf_size, sample)
    else:
        found = _by_blocks(*sides)
    order = Window.partitionBy("query_id").orderBy("power", "neighbor_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "neighbor_id", F.expr(metric.root_sql("power")).alias("distance"))


def _without_copies(train: DataFrame, features: Features, train_id: str, k: int) -> DataFrame:
    """Of equal rows those with the ``k`` smallest ids: a query that finds one of them finds these first."""
    order = Window.partitionBy("_x").orderBy(train_id)
    ranked = train.withColumn("_x", features.vector()).withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.col("_rank") <= k).drop("_x", "_rank")


def _by_broadcast(queries, query_features, query_id, few: pa.Table, neighbor: str, k, metric, tree, leaf_size) -> DataFrame:
    """``few`` are all training rows that any query may find, ``BROADCAST_ROWS`` at most; each task of queries holds them."""
    few = few.combine_chunks()
    ids, x = few.column("id").combine_chunks(), matrix(few.column("x").combine_chunks())
    tasks = max(queries.sparkSession.sparkContext.defaultParallelism, -(-queries.count() // (1 << 18)))
    own = queries.schema[query_id].dataType.simpleString()

    def search(batches):
        held = Held(ids, x, k, metric, leaf_size, tree)
        step = max(1, (1 << 20) // k)
        for batch in batches:
            points = matrix(batch.column(1))
            for i in range(0, batch.num_rows, step):
                row, col, power = held.best(points[i : i + step])
                rank = 1 + np.arange(len(row)) - np.searchsorted(row, row)
                columns = [batch.column(0).take(pa.array(i + row)), pa.array(rank, pa.int32()), held.ids.take(pa.array(col)), pa.array(power)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "rank", "neighbor_id", "power"])

    asked = queries.select(F.col(query_id).alias("query_id"), query_features.vector().alias("x")).repartition(tasks)
    found = asked.mapInArrow(search, f"query_id {own}, rank int, neighbor_id {neighbor}, power double")
    return found.select("query_id", "rank", "neighbor_id", F.expr(metric.root_sql("power")).alias("distance"))


def _by_blocks(queries, query_features, query_id, train, features, train_id, n_train, k, metric) -> DataFrame:
    """Training rows in blocks, queries in chunks, each pair of them a task's share; a block returns its own k best."""
    spark = queries.sparkSession
    blocks = max(1, -(-n_train // BLOCK_ROWS))
    chunks = max(1, -(-spark.sparkContext.defaultParallelism // blocks), -(-queries.count() // BLOCK_ROWS))
    spread = lambda c, n, seed: F.pmod(F.xxhash64(F.col(c), F.lit(seed)), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(
        (spread(query_id, chunks, 1) * blocks).alias("base"), F.lit(True).alias("asks"), F.col(query_id).alias("id"), query_features.vector().alias("x")
    ).withColumn("copy", copies(blocks)).select((F.col("base") + F.col("copy")).alias("cell"), "asks", "id", "x")
    right = train.select(
        spread(train_id, blocks, 2).alias("base"), F.lit(False).alias("asks"), F.col(train_id).alias("id"), features.vector().alias("x")
    ).withColumn("copy", copies(chunks)).select((F.col("base") + F.col("copy") * blocks).alias("cell"), "asks", "id", "x")
    neighbor = train.schema[train_id].dataType.simpleString()
    both = left.withColumn("id", F.col("id").cast(neighbor)).unionByName(right)
    dealt = both.repartitionById(blocks * chunks, F.col("cell")).sortWithinPartitions("cell", "asks")
    return dealt.mapInArrow(lambda batches: searched(batches, k, metric, 1), f"query_id {neighbor}, neighbor_id {neighbor}, power double")
