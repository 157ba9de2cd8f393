"""Connected components of an edge list, by alternating star contractions.

Each round makes every node's larger neighbours, then its smaller ones, point to the smallest node it sees; the number of
rounds is logarithmic in the number of nodes, whatever the shape. Edges stay in the cluster; the driver sees their count and a
checksum. Repeated edges count once, loops never, and an empty list has no nodes. A node with very many edges is one key of a join and of a pre-aggregated minimum, both of which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import cut, drop_cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come as a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    other = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return other.unionByName(own).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for each node of ``edges`` (a, b long, non-null); loops are ignored."""
    now = cut(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
        if not state[0]:
            break
        following = cut(_small_star(_large_star(now)), "edges")
        drop_cut(now)
        now = following
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
