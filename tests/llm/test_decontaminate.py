import itertools
import random

import numpy as np
import pytest
from fixtures import docs_frame, empty, mixed_rows, words

from tabulon.llm import decontaminate as D
from tabulon.llm.words import hash_words


def bench(spark, rows):
    return spark.createDataFrame([(i, t, 5) for i, t in rows], "item_id long, text string, doc_id long")


def best_overlap(doc, item):
    """Longest similar stretch over all offsets; its length, or 0."""
    best = 0
    for origin in range(-len(item) + 1, len(doc)):
        lo, hi = max(origin, 0), min(origin + len(item), len(doc))
        equal = [doc[i] == item[i - origin] for i in range(lo, hi)]
        least = min(D.LEAST, len(item))
        for a in range(len(equal)):
            for b in range(a + least, len(equal) + 1):
                if equal[a] and equal[b - 1] and sum(equal[a:b]) >= 0.8 * (b - a) - 1e-9:
                    best = max(best, b - a)
    return best


@pytest.mark.parametrize("length,substituted", [(13, 2), (14, 2), (15, 3), (17, 3), (20, 4)])
def test_masks_hit_every_overlap_that_counts(length, substituted):
    shapes = [sum(1 << p for p in m) << s for m in D.MASKS for s in range(length - m[-1])]
    for bad in itertools.combinations(range(1, length - 1), substituted):
        hit = sum(1 << b for b in bad)
        assert any(not shape & hit for shape in shapes)


@pytest.mark.parametrize("n", range(1, 13))
def test_short_masks_hit_every_overlap_that_counts(n):
    masks = D.short_masks(n)
    assert all(m[0] == 0 and m[-1] == n - 1 for m in masks)
    for bad in itertools.combinations(range(1, n - 1), n // 5):
        assert any(not set(m) & set(bad) for m in masks)


def test_longest_similar_against_all_stretches():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        equal = rng.random(rng.integers(1, 40)) < rng.choice([0.5, 0.75, 0.9])
        least = int(rng.integers(1, 14))
        every = [
            (b - a, int(equal[a:b].sum()), -a) for a in range(len(equal)) for b in range(a + least, len(equal) + 1)
            if equal[a] and equal[b - 1] and 5 * equal[a:b].sum() >= 4 * (b - a)
        ]
        found = D.longest_similar(equal, least)
        if not every:
            assert found is None
        else:
            a, b = found
            assert (b - a, int(equal[a:b].sum()), -a) == max(every)


def test_a_long_copy_takes_linear_time():
    equal = np.ones(2_000_000, dtype=bool)
    equal[::7] = False
    assert D.longest_similar(equal, 13) == (1, 2_000_000)


def test_hits_are_verified_some_at_a_time(spark, monkeypatch):
    rng = random.Random(8)
    phrase = words(rng, 9, 50)
    items = [(i, f"{phrase} {words(rng, 12, 1000)}") for i in range(30)]
    rows = [(i, f"{words(rng, 20, 1000)} {phrase} {items[i][1]}") for i in range(10)]
    want = D.find_overlaps(docs_frame(spark, rows), bench(spark, items)).orderBy("doc_id", "item_id").collect()
    assert len(want) >= 10
    table = D.SeedTable.of([i for i, _ in items], [t.encode() for _, t in items])
    monkeypatch.setattr(D, "_HITS", 7)
    found = table.overlaps(*hash_words([t.encode() for _, t in rows]))
    assert [(r["doc_id"], r["item_id"], *r[2:]) for r in want] == [(rows[d][0], items[i][0], *rest) for d, i, *rest in found]


def test_word_hashes():
    texts = [b"", b" A b\tC ", b"abc ABC aBC\x0bx", b"", "é É".encode(), b"a" * 100]
    h, bounds = hash_words(texts)
    assert bounds.tolist() == [0, 0, 3, 7, 7, 9, 10]
    assert h[3] == h[4] == h[5] and h[7] != h[8]
    assert hash_words([])[1].tolist() == [0]
    long = (b"some words here \n" * 80_000) + b"end"
    assert np.array_equal(hash_words([long])[0], hash_words(long.split())[0])


def test_against_brute_force(spark):
    rng = random.Random(5)
    items = [(i, words(rng, n, 60)) for i, n in enumerate([2, 3, 4, 5, 6, 9, 10, 12, 12, 13, 20, 30])] + [(50, None), (51, ""), (52, "a b"), (53, "single")]
    rows = [(900, "just a single word"), (901, None)]
    for i in range(40):
        text = words(rng, 60, 60).split()
        if i % 2:
            part = rng.choice(items[:12])[1].upper().split()
            for _ in range(rng.randrange(4)):
                part[rng.randrange(len(part))] = "new"
            text[20:20] = part[rng.randrange(2) :]
        rows.append((i, " ".join(text)))
    found = {(r["doc_id"], r["item_id"]): r for r in D.find_overlaps(docs_frame(spark, rows), bench(spark, items)).collect()}
    want = {}
    for (d, t), (i, b) in itertools.product(rows, items):
        n = best_overlap((t or "").lower().split(), (b or "").lower().split())
        if n:
            want[d, i] = n
    assert {k: r["doc_end"] - r["doc_start"] for k, r in found.items()} == want
    assert len(want) > 8
    in_blocks = D.find_overlaps(docs_frame(spark, rows), bench(spark, items), block_words=10).collect()
    assert {(r["doc_id"], r["item_id"]) for r in in_blocks} == set(want)


def test_keeps_clean_documents(spark):
    rng = random.Random(6)
    item = words(rng, 30, 10_000)
    rows = mixed_rows()
    df = docs_frame(spark, [*rows, (777, "intro " + item + " outro")])
    kept = D.remove_contaminated(df, bench(spark, [(1, item), (2, None)]))
    assert kept.columns == df.columns
    assert kept.count() == len(rows) and kept.filter("doc_id = 777").count() == 0


def test_empty_tables(spark):
    b = bench(spark, [(1, words(random.Random(0), 20))])
    assert D.find_overlaps(empty(spark), b).count() == 0
    assert D.find_overlaps(docs_frame(spark, [(1, "a")]), b.limit(0)).count() == 0
    assert D.remove_contaminated(docs_frame(spark, [(1, "a")]), b.limit(0)).count() == 1
