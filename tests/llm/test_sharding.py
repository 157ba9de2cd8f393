import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import docs_frame, empty, mixed_rows
from pyspark.sql import functions as F

from tabulon.llm.sharding import communication_matrix, hypergeometric, shard


def test_hypergeometric_moments_and_bounds():
    rng = random.Random(0)
    draws = [hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(sum(draws) / len(draws) - 6) < 0.1
    variance = sum((d - 6) ** 2 for d in draws) / len(draws)
    assert abs(variance - 20 * 0.3 * 0.7 * 80 / 99) < 0.25
    assert hypergeometric(rng, 5, 0, 3) == 3 and hypergeometric(rng, 0, 5, 3) == 0
    assert 0 <= hypergeometric(rng, 10**11, 4 * 10**12, 10**6) <= 10**6


@pytest.mark.parametrize("good,bad,drawn", [(3, 4, 5), (10**9, 10**9, 40), (25 * 10**10, 975 * 10**10, 500_000)])
def test_hypergeometric_probabilities(good, bad, drawn):
    """Frequencies against exact binomial coefficients, up to 10**13 rows."""
    rng, n = random.Random(1), 4000
    draws = Counter(hypergeometric(rng, good, bad, drawn) for _ in range(n))
    mean = drawn * good / (good + bad)
    sd = math.sqrt(mean * bad / (good + bad) * (good + bad - drawn) / (good + bad - 1))
    assert abs(sum(k * c for k, c in draws.items()) / n - mean) < 5 * sd / math.sqrt(n)
    if drawn <= 40:
        ways = {k: math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn) for k in range(drawn + 1)}
        assert all(abs(draws[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3 for k, p in ways.items())


def test_matrix_is_a_uniform_deal():
    """Matrices of five rows in two sources and two shards against the share of all deals that give each."""
    want = Counter()
    for deal in itertools.permutations([0, 0, 1, 1, 1]):
        want[sum(s == 0 for s in deal[:3]), sum(s == 0 for s in deal[3:])] += 1
    found = Counter(tuple(r[0] for r in communication_matrix([3, 2], [2, 3], seed)) for seed in range(6000))
    assert all(abs(found[k] / 6000 - n / 120) < 0.03 for k, n in want.items()) and set(found) == set(want)


def test_shards_and_slots_are_uniform(spark):
    """Ids in order and in runs, in many sources and blocks: shards and slots depend on neither (chi-square, five sigma)."""
    n, shards, runs = 6000, 5, 10
    found = shard(docs_frame(spark, [(i, "same") for i in range(n)]), shards=shards, ranked_rows=300).collect()
    for column, parts in (("shard", shards), ("slot", n // shards)):
        table = np.zeros((runs, 5))
        for r in found:
            table[r["doc_id"] * runs // n, r[column] * 5 // parts] += 1
        chi = ((table - n / runs / 5) ** 2 / (n / runs / 5)).sum()
        free = (runs - 1) * 4
        assert abs(chi - free) < 5 * math.sqrt(2 * free)
    followers = sum(a["shard"] == b["shard"] for a, b in zip(*(lambda s: (s, s[1:]))(sorted(found, key=lambda r: r["doc_id"]))))
    assert abs(followers / n - 1 / shards) < 5 * math.sqrt(0.16 / n)


def test_one_id_is_spread(spark):
    """A third of all rows without an id, and one row many times over, told apart by their place."""
    rows = [(None, f"text {i}") for i in range(100)] + [(5, "again")] * 100 + [(1000 + i, "t") for i in range(100)]
    df = docs_frame(spark, rows).coalesce(1).withColumn("place", F.monotonically_increasing_id())
    for ids in (None, 5):
        own = df.filter(F.col("doc_id").eqNullSafe(F.lit(ids)))
        assert own.select(F.expr("xxhash64(doc_id, place, 1) % 8")).distinct().count() > 4
    check(spark, rows, shard(df, shards=7, ranked_rows=20, salt=F.col("place")).collect(), 7)


def test_matrix_sums():
    counts, quotas = [7, 0, 13, 20], [14, 13, 13]
    m = communication_matrix(counts, quotas, 3)
    assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m)] == quotas


def check(spark, rows, found, shards):
    n = len(rows)
    sizes = Counter(r["shard"] for r in found)
    assert len(found) == n and set(sizes.values()) <= {n // shards, -(-n // shards)}
    for s in sizes:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sizes[s]))
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want


def test_rows_law_and_edges(spark):
    rows = mixed_rows()
    for ranked in (500_000, 2):  # 2: many sources and blocks
        found = shard(docs_frame(spark, rows), shards=7, ranked_rows=ranked).collect()
        check(spark, rows, found, 7)


def test_same_again_and_other_seed(spark):
    df = docs_frame(spark, [(i, str(i)) for i in range(300)])
    a, b = (shard(df.repartition(p), shards=4).orderBy("doc_id").collect() for p in (3, 5))
    assert a == b
    c = shard(df, shards=4, seed=9).orderBy("doc_id").collect()
    assert sum(x["shard"] == y["shard"] for x, y in zip(a, c)) < 150


def test_empty_and_hot(spark):
    assert shard(empty(spark)).count() == 0
    rows = [(i, "the same") for i in range(100)]
    check(spark, rows, shard(docs_frame(spark, rows), shards=40).collect(), 40)
