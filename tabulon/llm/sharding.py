"""Uniform sharding by a hypergeometric communication matrix, in DataFrame operations only.

Rows are dealt to source partitions by a hash of their id and of a ``salt`` (the row's place in its file, in the query), so that a
recomputed task finds the same rows and rows without an id, or with one and the same, are spread like any others. The
driver sees one count for each source partition and draws, source by source, how many rows go to each shard: a
multivariate hypergeometric draw from what each shard still lacks. Row sums are the partitions' counts and column
sums the exact shard sizes, so the law is ``rows``: shard sizes differ by one at most. Each source ranks its rows by
one random key (the local permutation) and cuts the ranking at the drawn counts, which reach the rows by a join that the ranking's
partitioning already serves; after the exchange each shard ranks by a second, independent key. Given the keys are random,
every assignment with these shard sizes is equally likely.

Edge cases: a null text has size 16 and the crc of the empty text; a very long one is one row like any other, only its size and crc move; null ids
order first; repeated rows get different slots; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import json
import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 40
SEED = 20_240_817
#: Rows that one source partition or one block of a shard ranks, on average.
RANKED_ROWS = 500_000
_UNIT = 1 << 63


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` items, taken without replacement, are good.

    Inversion over twelve standard deviations around the mode. Probabilities are products of exact ratios from the mode
    outwards, over their own sum, so nothing is lost at any number of items.
    """
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(drawn * (good / total) * (bad / total) * ((total - drawn) / max(1, total - 1)))
    reach = 40 + int(12 * spread)
    up = np.arange(mode, min(high, mode + reach), dtype=float)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=float)
    above = np.cumprod((good - up) / (up + 1) * ((drawn - up) / (bad - drawn + up + 1)))
    below = np.cumprod(down / (good - down + 1) * ((bad - drawn + down) / (drawn - down + 1)))
    weights = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    at = int(np.searchsorted(weights, rng.random() * weights[-1], "right"))
    return mode - len(below) + min(at, len(weights) - 1)


def communication_matrix(counts: list[int], quotas: list[int], seed: int) -> list[list[int]]:
    """Entry [i][j]: rows that source i sends to shard j; rows sum to ``counts``, columns to ``quotas``."""
    rng, lacking, matrix = random.Random(seed), list(quotas), []
    for count in counts:
        row, left, rest = [], count, sum(lacking)
        for j, quota in enumerate(lacking):
            rest -= quota
            x = hypergeometric(rng, quota, rest, left)
            row.append(x)
            lacking[j] -= x
            left -= x
        matrix.append(row)
    return matrix


def _key(seed: int, salt: Column) -> Column:
    return F.xxhash64(F.col("doc_id"), salt, F.lit(seed)).bitwiseAND(F.lit(_UNIT - 1))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, ranked_rows: int = RANKED_ROWS, salt: Column | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for each row of ``docs`` (columns doc_id, text).

    slot runs from 0 without gaps in each shard. Two jobs: counts by source partition, then the result's plan. ``salt`` tells rows of
    one id apart and must not change when a row is read again; unless given it is a hash of the text.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", "text", (F.xxhash64("text") if salt is None else salt).alias("salt"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        "salt",
    )
    key = lambda n: _key(seed + n, F.col("salt"))
    total = docs.count()
    sources = max(8, math.ceil(total / ranked_rows))
    source = (key(0) % sources).cast("int")
    found = {r["source"]: r["n"] for r in docs.groupBy(source.alias("source")).agg(F.count("*").alias("n")).collect()}
    quotas = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = communication_matrix([found.get(i, 0) for i in range(sources)], quotas, seed)
    cuts = [{"source": i, "edges": list(itertools.accumulate(row[:-1]))} for i, row in enumerate(matrix)]
    cuts = F.from_json(F.lit(json.dumps(cuts)), "array<struct<source: int, edges: array<bigint>>>")
    edges = spark.range(1).select(F.explode(cuts).alias("e")).select("e.*").hint("merge")  # a row for each source

    stable = ["doc_id", "text_crc32", "size", "salt"]
    first = Window.partitionBy("source").orderBy("key", *stable)
    ranked = rows.withColumns({"source": source, "key": key(1)}).withColumn("rank", F.row_number().over(first) - 1)
    blocks = max(1, math.ceil(total / shards / ranked_rows))
    dealt = ranked.join(edges, "source").select(
        *stable,
        F.size(F.filter("edges", lambda e: e <= F.col("rank"))).alias("shard"),
        key(2).alias("key"),
    )
    dealt = dealt.withColumn("block", F.floor(F.col("key") / F.lit(float(_UNIT)) * blocks).cast("int"))
    second = Window.partitionBy("shard", "block").orderBy("key", *stable)
    placed = dealt.withColumn("within", F.row_number().over(second).cast("long") - 1)
    if blocks > 1:
        before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        starts = dealt.groupBy("shard", "block").agg(F.count("*").alias("n")).select(
            "shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
        )
        placed = placed.join(starts, ["shard", "block"]).withColumn("within", F.col("within") + F.col("start"))
    return placed.select(*stable[:3], "shard", F.col("within").alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every document in shards 0 to 39 under the law ``rows``."""
    place = F.xxhash64("_metadata.file_name", "_metadata.row_index")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", place.alias("place"))
    return shard(docs, salt=F.col("place")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def totals(spark, sf_dir: str) -> DataFrame:
    """What the law ``rows`` fixes of op1's result: each shard's rows and slots, and the sizes of all rows together."""
    found = query(spark, sf_dir)
    by_shard = found.groupBy("shard").agg(
        F.count("*").alias("n_rows"),
        F.min("slot").alias("first_slot"),
        F.max("slot").alias("last_slot"),
        F.countDistinct("slot").alias("n_slots"),
        F.sum("size").alias("bytes"),
        F.sum("doc_id").alias("ids"),
    )
    everything = Window.partitionBy()  # 40 rows
    return by_shard.withColumns({"bytes": F.sum("bytes").over(everything), "ids": F.sum("ids").over(everything)})


TOTALS_SQL = """
WITH t AS (SELECT count(*) AS n, sum(octet_length(encode(coalesce(text, ''))) + 16) AS bytes, sum(doc_id) AS ids FROM documents),
s AS (SELECT range AS shard, n // 40 + CASE WHEN range < n % 40 THEN 1 ELSE 0 END AS rows_, bytes, ids FROM t, range(40))
SELECT shard::INTEGER AS shard, rows_::BIGINT AS n_rows, 0::BIGINT AS first_slot, (rows_ - 1)::BIGINT AS last_slot, rows_::BIGINT AS n_slots,
  bytes::BIGINT AS bytes, ids::BIGINT AS ids
FROM s WHERE rows_ > 0
"""
