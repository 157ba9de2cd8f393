"""Nearest neighbours by inner product: stable projections, a kd-tree over them, verification until a chi-square test holds.

Vectors are lengthened by one component that makes all norms equal, so that the largest inner product is the smallest distance.
A fixed Gaussian matrix takes them to ``PROJECTED`` dimensions; the squared projected distance of two vectors over their squared
distance follows a chi-square law. A kd-tree over the projected points gives a query its neighbours in
order of projected distance; each is verified by its inner product. The search ends once a vector as near as
the k-th found would, with probability ``CONFIDENCE``, have come up before the next projected distance.

The tree has two levels. Its upper splits come from a sample of ``SAMPLE_ROWS`` rows at most and deal all vectors to blocks of about
``BLOCK`` (``MOST_BLOCKS`` at most, so that their boxes have a bounded size); each block builds its own tree. A query first searches the
block nearest to it, then, with the k-th product found there as a start, only blocks that begin before the test holds.
The sample shapes the blocks only: every row is indexed.

Edge cases: vectors that are null, zero, hold a null or non-finite component, have no id, or have another length than most
take no part; rows that repeat an id are candidates each, but none for a query of that id, which is asked once; ties go to the
smaller id; with fewer than k candidates all are returned; of rows that repeat a query's id the smallest vector asks; an empty
table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.common import cut
from tabulon.plans.cells import Splits
from tabulon.plans.partials import matrix

PROJECTED = 6
CONFIDENCE = 0.95
BLOCK = 8192
MOST_BLOCKS = 4096
SAMPLE_ROWS = 16_384
LEAF = 64
SEED = 5
QUERY_EVERY = 20
NEIGHBORS = 20


def chi_square_quantile(p: float, dims: int) -> float:
    """The ``p`` quantile for an even number of dimensions: its upper tail is a Poisson sum."""
    def below(x: float) -> float:
        term = total = 1.0
        for j in range(1, dims // 2):
            term *= x / 2 / j
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 10.0 * dims + 100
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


@dataclass
class Projection:
    """``matrix`` takes lengthened vectors (norm ``reach``) to few dimensions."""

    matrix: np.ndarray
    reach: float

    @classmethod
    def of(cls, dims: int, reach: float, projected: int = PROJECTED, seed: int = SEED) -> Projection:
        return cls(np.random.default_rng(seed).standard_normal((dims + 1, projected)), reach)

    def points(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.reach**2 - np.einsum("ij,ij->i", x, x), 0))
        return x @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def queries(self, x: np.ndarray) -> np.ndarray:
        return x @ self.matrix[:-1]


class BlockIndex:
    """A kd-tree over the projected points of one block; points are stored leaf by leaf."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projection: Projection, leaf: int = LEAF):
        points = projection.points(vectors)
        order, sizes = [], []
        stack = [np.arange(len(ids))]
        while stack:
            part = stack.pop()
            if len(part) <= leaf:
                order.append(part)
                sizes.append(len(part))
                continue
            own = points[part]
            axis = int(np.argmax(np.ptp(own, axis=0)))
            half = np.argpartition(own[:, axis], len(part) // 2)
            stack += [part[half[len(part) // 2 :]], part[half[: len(part) // 2]]]
        at = np.concatenate(order)
        self.ids, self.vectors, self.points, self.projection = ids[at], vectors[at], points[at], projection
        self.single = self.vectors.astype(np.float32) if projection.reach < 1e15 else self.vectors
        self.slack = 1e-5 * (1 + projection.reach) ** 2  # more than single precision can be off by, twice
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.low = np.minimum.reduceat(self.points, self.starts)
        self.high = np.maximum.reduceat(self.points, self.starts)

    def search(self, query_id: int, query: np.ndarray, k: int, quantile: float, known: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and inner products of the ``k`` best found, and how many points were verified.

        ``known`` is a product that ``k`` vectors elsewhere reach: less is neither looked for nor returned.
        """
        q = self.projection.queries(query[None])[0]
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        bound = np.einsum("ij,ij->i", gap, gap)
        leaves = np.argsort(bound, kind="stable")
        bound = np.append(bound[leaves], np.inf)
        single = query.astype(self.single.dtype)
        far = float(query @ query) + self.projection.reach**2  # squared distance: far - 2 * inner product
        pool, pool_at = np.zeros(0), np.zeros(0, dtype=np.int64)
        best, best_at = np.zeros(0, dtype=np.float32), np.zeros(0, dtype=np.int64)
        done, step, verified = 0, 4, 0
        while True:
            part = leaves[done : done + step]
            done += len(part)
            step = min(step * 2, 64)
            at = np.concatenate([np.arange(self.starts[i], self.ends[i]) for i in part]) if len(part) else np.zeros(0, dtype=np.int64)
            gap = self.points[at] - q
            pool, pool_at = np.append(pool, np.einsum("ij,ij->i", gap, gap)), np.append(pool_at, at)
            ready = pool <= bound[done]  # nothing in a later leaf is nearer in the projection
            at, pool_at, pool = pool_at[ready], pool_at[~ready], pool[~ready]
            at = at[self.ids[at] != query_id]
            verified += len(at)
            best, best_at = np.append(best, self.single[at] @ single), np.append(best_at, at)
            if len(best) > 4 * k:
                kth = np.partition(best, len(best) - k)[len(best) - k]
                near = best >= kth - 2 * self.slack
                best, best_at = best[near], best_at[near]
            if done >= len(leaves):
                break
            kth = max(known, np.partition(best, len(best) - k)[len(best) - k] if len(best) >= k else -np.inf)
            if bound[done] >= quantile * max(far - 2 * (kth - self.slack), 0):
                break
        if len(best) > k:
            best_at = best_at[best >= np.partition(best, len(best) - k)[len(best) - k] - 2 * self.slack]
        exact = (self.vectors[best_at] * query).sum(axis=1)  # the same sum wherever a vector lies
        best_at, exact = best_at[exact >= known], exact[exact >= known]
        order = np.lexsort((self.ids[best_at], -exact))[:k]
        return self.ids[best_at][order], exact[order], verified


_DEALT = ["block", "query", "vec_id", "v", "known"]


def _boxes(rows: DataFrame, projection: Projection, splits: Splits) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest projected coordinates of each block's rows; infinitely far for blocks without any."""

    def run(batches):
        low, high = np.full((splits.leaves, PROJECTED), np.inf), np.full((splits.leaves, PROJECTED), -np.inf)
        for batch in batches:
            if batch.num_rows:
                points = projection.points(matrix(batch.column(0)))
                at = splits.leaves_of(points)
                np.minimum.at(low, at, points)
                np.maximum.at(high, at, points)
        leaf, axis = np.nonzero(np.isfinite(low))
        columns = [pa.array(leaf), pa.array(axis), pa.array(low[leaf, axis]), pa.array(high[leaf, axis])]
        yield pa.RecordBatch.from_arrays(columns, ["leaf", "axis", "low", "high"])

    parts = rows.select("v").mapInArrow(run, "leaf long, axis long, low double, high double")
    found = parts.groupBy("leaf", "axis").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    low, high = np.full((splits.leaves, PROJECTED), np.inf), np.full((splits.leaves, PROJECTED), np.inf)
    low[found["leaf"], found["axis"]], high[found["leaf"], found["axis"]] = found["low"], found["high"]
    return low, high


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` (array of doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)
        .filter(F.exists("v", lambda x: x != 0))
    )


def nearest(vectors: DataFrame, k: int = NEIGHBORS, every: int = QUERY_EVERY, block: int = BLOCK, confidence: float = CONFIDENCE) -> DataFrame:
    """``query_id, rank, vec_id, score, verified``: for each row whose id is divisible by ``every``, its ``k`` nearest others.

    ``vectors`` has vec_id and embedding. ``verified`` counts the inner products that the query's blocks computed.
    """
    rows = usable(vectors)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    shapes = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.max(norm).alias("most")).collect()
    schema = "query_id long, vec_id long, score double, verified long"
    if not shapes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    shape = max(shapes, key=lambda r: (r["n"], r["dims"]))
    rows = rows.filter(F.size("v") == shape["dims"])
    projection = Projection.of(shape["dims"], math.sqrt(shape["most"]) * (1 + 1e-12))
    quantile = chi_square_quantile(confidence, PROJECTED)
    share = min(1.0, 1.2 * SAMPLE_ROWS / shape["n"])
    some = (rows.sample(share, seed=SEED) if share < 1 else rows).limit(SAMPLE_ROWS).select("v").toArrow()
    sampled = matrix(some.column("v").combine_chunks())
    splits = Splits.of(projection.points(sampled) if len(sampled) else np.zeros((0, PROJECTED)), min(MOST_BLOCKS, -(-shape["n"] // block)))
    boxes = _boxes(rows, projection, splits)

    def store(batches):
        for batch in batches:
            at = splits.leaves_of(projection.points(matrix(batch.column(1))))
            none = pa.nulls(len(at), pa.float64())
            columns = [pa.array(at), pa.array(np.zeros(len(at), dtype=bool)), *batch.columns, none]
            yield pa.RecordBatch.from_arrays(columns, _DEALT)

    def ask(first: bool):
        def run(batches):
            step = max(1, (1 << 20) // len(boxes[0]))
            for batch in batches:
                for i in range(0, batch.num_rows, step):
                    part = batch.slice(i, step)
                    x = matrix(part.column(1))
                    q = projection.queries(x)
                    bound = np.zeros((len(q), len(boxes[0])))
                    for j in range(PROJECTED):
                        bound += np.maximum(np.maximum(boxes[0][None, :, j] - q[:, j, None], q[:, j, None] - boxes[1][None, :, j]), 0) ** 2
                    home = bound.argmin(axis=1)
                    if first:
                        row, leaf = np.arange(len(q)), home
                    else:
                        known = part.column(2).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                        far = np.einsum("ij,ij->i", x, x) + projection.reach**2
                        slack = 1e-5 * (1 + projection.reach) ** 2
                        need = bound < (quantile * np.maximum(far - 2 * (known - slack), 0))[:, None]
                        need[np.arange(len(q)), home] = False
                        row, leaf = np.nonzero(need & np.isfinite(bound))
                    own = pa.array(row)
                    columns = [pa.array(leaf), pa.array(np.ones(len(row), dtype=bool)), *(c.take(own) for c in part.columns)]
                    yield pa.RecordBatch.from_arrays(columns, _DEALT)

        return run

    def search(batches):
        index, ids, parts, now = None, [], [], None
        for batch in batches:
            tags, queries, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            flat, known = matrix(batch.column(3)), batch.column(4).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            # Runs of one block's vectors, or of one block's queries.
            change = (tags[1:] != tags[:-1]) | (queries[1:] != queries[:-1])
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(keys)] if len(keys) else []
            for a, b in zip(edges, edges[1:]):
                if tags[a] != now:
                    index, ids, parts, now = None, [], [], tags[a]
                if not queries[a]:
                    ids.append(keys[a:b])
                    parts.append(flat[a:b])
                    continue
                if index is None:
                    if not ids:
                        continue
                    index = BlockIndex(np.concatenate(ids), np.concatenate(parts), projection)
                    parts = []
                out = [[], [], [], []]
                for key, q, least in zip(keys[a:b], flat[a:b], known[a:b]):
                    found, score, verified = index.search(key, q, k, quantile, least)
                    effort = np.zeros(len(found), dtype=np.int64)
                    effort[:1] = verified
                    for column, x in zip(out, (np.full(len(found), key), found, score, effort)):
                        column.append(x)
                columns = [pa.array(np.concatenate(x)) for x in out]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score", "verified"])

    kinds = "block long, query boolean, vec_id long, v array<double>, known double"
    stored = rows.mapInArrow(store, kinds)
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))

    def searched(queries: DataFrame, first: bool) -> DataFrame:
        dealt = stored.unionByName(queries.mapInArrow(ask(first), kinds)).repartition(splits.leaves, "block")
        return dealt.sortWithinPartitions("block", "query").mapInArrow(search, schema)

    near = cut(searched(asked.withColumn("known", F.lit(None).cast("double")), True), "near")
    reached = near.groupBy(F.col("query_id").alias("of")).agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    known = F.when(F.col("n") >= k, F.col("kth"))
    found = near.unionByName(searched(asked.join(reached, F.col("vec_id") == F.col("of"), "left").select("vec_id", "v", known.alias("known")), False))
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumns({
        "rank": F.row_number().over(by_query),
        "verified": F.sum("verified").over(Window.partitionBy("query_id")),
    })
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "verified")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the 20 nearest of every vector whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors).select("query_id", "rank", "vec_id", "score")
