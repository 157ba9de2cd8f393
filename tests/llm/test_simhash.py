import functools
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from fixtures import docs_frame, empty, mixed_rows, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.llm import simhash as S
from tabulon.llm.graph import components


def plain_fingerprint(text, n=4):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint():
    for text in ("", None, "one", "A b C d E f g", "x " * 50, "Ä B\x0bc d\x1ce"):
        assert S.fingerprint((text or "").encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("radius,count", [(4, 2), (4, 3), (4, 4), (7, 3), (7, 4), (3, 8)])
def test_segments_lose_nothing(radius, count):
    rng = random.Random(radius)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), radius):
            b ^= 1 << bit
        assert any(((a ^ b) >> f & (1 << w) - 1).bit_count() <= r for f, w, r in S.segments(radius, count))
        ka, pa_, _ = S.entries(np.array([a], dtype=np.uint64), radius, count)
        kb, pb, _ = S.entries(np.array([b], dtype=np.uint64), radius, count)
        assert set(ka[~pa_].tolist()) & set(kb.tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=6), st.integers(0, 10**6))
def test_search_links_chains(centers, seed):
    rng = random.Random(seed)
    fps = set(centers)
    for c in centers:
        for _ in range(6):
            for bit in rng.sample(range(64), rng.randrange(4)):
                c ^= 1 << bit
            fps.add(c)
    fps = np.array(sorted(fps), dtype=np.uint64)
    for found in (S.reach(fps, np.ones(len(fps), dtype=bool), 4), S.split_search(fps, np.ones(len(fps), dtype=bool), 4, most=3)):
        want = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 4]
        assert union(len(fps), zip(*found)) == union(len(fps), want)


def test_classes_against_brute_force(spark):
    rows = mixed_rows()
    found = S.near_groups(docs_frame(spark, rows)).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    roots = union(len(rows), pairs)
    least = {}
    for (doc, _), r in zip(rows, roots):
        least[r] = min(x for x in (least.get(r), doc) if x is not None) if (least.get(r), doc) != (None, None) else None
    want = sorted(((d is None, d or 0), f - (f >> 63 << 64), least[r]) for (d, _), f, r in zip(rows, fps, roots))
    assert sorted(((x["doc_id"] is None, x["doc_id"] or 0), x["fp"], x["component_id"]) for x in found) == want


def test_hot_entries_are_dealt_on(spark, monkeypatch):
    """Hundreds of fingerprints in each entry, of which a task should hold 50: the classes of all pairs."""
    rng = random.Random(13)
    fps = set()
    for _ in range(8):
        base = rng.getrandbits(8) | 0xABCD << 48 | 0x1234 << 24
        for _ in range(40):
            x = base
            for bit in rng.sample(range(64), rng.randrange(7)):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    want = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    df = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    place = {f - (f >> 63 << 64): i for i, f in enumerate(fps)}
    for held in (1 << 20, 50):
        monkeypatch.setattr(S, "ENTRY_ROWS", held)
        assert union(len(fps), [(place[r["a"]], place[r["b"]]) for r in S.links(df).collect()]) == want


def test_hot_group_and_empty(spark):
    """Thousands of near copies: one class, and fewer links than table entries (some 45 a fingerprint)."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 3000:
        x = base
        for bit in rng.sample(range(64), 3):
            x ^= 1 << bit
        fps.add(x)
    df = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    found = S.links(df)
    assert found.count() < 48 * len(fps) < len(fps) ** 2 / 50
    assert components(found).select("component").distinct().count() == 1
    assert S.near_groups(empty(spark)).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (101, 100)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_similar_groups(spark):
    rng = random.Random(8)
    base = words(rng, 200, 10_000).split()
    near, half = list(base), list(base)
    near[100] = "other"
    half[100:] = words(rng, 100, 10_000).split()
    rows = [(3, " ".join(base)), (1, " ".join(near)), (2, " ".join(half)), (9, " ".join(base)), (9, " ".join(base)), (5, None), (4, "")]
    df = docs_frame(spark, rows)
    groups = {(r["doc_id"], r["keeper"]) for r in S.similar_groups(df).collect()}
    assert groups == {(3, 1), (1, 1), (2, 2), (9, 1), (5, 4), (4, 4)}
    kept = S.drop_similar(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4]
    assert S.drop_similar(docs_frame(spark, [(7, "a b"), (7, "a b"), (None, "c"), (None, "d")])).count() == 3


def test_texts_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """Three values for all first hashes: the same documents stay as with 64 bits."""
    rows = mixed_rows() + [(2000, "no id"), (2000, "no id")]
    df = docs_frame(spark, rows)
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in S.drop_similar(df).collect())
    plain = {(r["doc_id"], r["keeper"]) for r in S.similar_groups(df).collect()}
    monkeypatch.setattr(S, "_text_hashes", lambda t: (F.pmod(F.xxhash64(F.coalesce(t, F.lit(""))), F.lit(3)), F.xxhash64(F.lit(1), F.coalesce(t, F.lit("")))))
    assert {(r["doc_id"], r["keeper"]) for r in S.similar_groups(df).collect()} == plain
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in S.drop_similar(df).collect()) == want


def keepers_of(rows, near, words=5, similarity=0.8):
    """Keepers by all pairs: those that ``near`` lets through are checked on their shingle sets."""
    sets = [set(S.shingle_hashes((t or "").encode(), words).tolist()) for _, t in rows]
    alike = lambda a, b: len(a & b) >= similarity * len(a | b)
    n = range(len(rows))
    roots = union(len(rows), [(i, j) for i in n for j in range(i) if near(i, j) and alike(sets[i], sets[j])])
    return {rows[i][0]: min(rows[j][0] for j in n if roots[j] == roots[i]) for i in n}


def family_rows(families, copies, seed=5):
    """Near copies of several base texts, in a mixed order."""
    rng, texts = random.Random(seed), []
    for f in range(families):
        base = [f"f{f}x{rng.randrange(10_000)}" for _ in range(150)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(1, 3)):
                w[rng.randrange(150)] = f"new{rng.randrange(10_000)}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_similar_texts_are_joined_whatever_shares_their_fingerprint(spark, monkeypatch):
    """Eight fingerprints within three bits over five families, two candidates a text: a check that fails says nothing about other pairs."""
    at = lambda docs, words: docs.select("doc_id", "text_hash", F.pmod("doc_id", F.lit(8)).alias("fp"), F.lit(0).cast("long").alias("fp2"))
    monkeypatch.setattr(S, "set_fingerprints", at)
    monkeypatch.setattr(S, "NEAREST", 2)
    rows = family_rows(5, 12)
    want = keepers_of(rows, lambda i, j: True)
    assert len(set(want.values())) == 5
    found = S.similar_groups(docs_frame(spark, rows)).collect()
    assert {r["doc_id"]: r["keeper"] for r in found} == want
    monkeypatch.setattr(S, "BLOCK", 7)  # families over several blocks
    found = S.similar_groups(docs_frame(spark, rows)).collect()
    assert {r["doc_id"]: r["keeper"] for r in found} == want


def test_rounds_lose_no_link(spark, monkeypatch):
    """Beyond ``PART_BYTES`` tables, sets, pairs and blocks are written some at a time; the groups are the same."""
    at = lambda docs, words: docs.select("doc_id", "text_hash", F.pmod("doc_id", F.lit(8)).alias("fp"), F.lit(0).cast("long").alias("fp2"))
    monkeypatch.setattr(S, "set_fingerprints", at)
    monkeypatch.setattr(S, "NEAREST", 2)
    monkeypatch.setattr(S, "BLOCK", 7)
    rows = family_rows(3, 12)
    want = keepers_of(rows, lambda i, j: True)
    monkeypatch.setattr(S, "PART_BYTES", -(-sum(len(t.encode()) for _, t in rows) // 2))
    labels = []
    real = S.cut
    monkeypatch.setattr(S, "cut", lambda df, label="cut", *rest: labels.append(label) or real(df, label, *rest))
    found = S.similar_groups(docs_frame(spark, rows)).collect()
    assert {r["doc_id"]: r["keeper"] for r in found} == want
    assert (labels.count("shingles"), labels.count("alike"), labels.count("blocks")) == (2, 3, 2)
    assert labels.count("table") > 1 and labels.count("fresh") > 1


@pytest.mark.parametrize("most,dense,held", [(3, 2048, 1 << 20), (1000, 2048, 1 << 20), (3, 4, 1 << 20), (3, 4, 64)])
def test_candidates(spark, monkeypatch, most, dense, held):
    """Each node's nearest within the bits of both fingerprints, or what leads to them: the same components as all pairs."""
    monkeypatch.setattr(S, "PIECE", dense)
    monkeypatch.setattr(S, "ENTRY_ROWS", held)
    rng = random.Random(4)
    flip = lambda x, n: functools.reduce(lambda v, b: v ^ 1 << b, rng.sample(range(63), n), x)
    base = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(3)]
    rows = [(i, *(flip(f, rng.randrange(6)) for f in base[i % 3])) for i in range(240)] + [(500 + i, rng.getrandbits(63), 0) for i in range(30)]
    every = S.candidates_of(spark.createDataFrame(rows, "node long, fp long, fp2 long"), 11, 32, most).collect()
    place = {n: k for k, (n, _, _) in enumerate(rows)}
    far = lambda i, j: ((rows[i][1] ^ rows[j][1]).bit_count(), (rows[i][2] ^ rows[j][2]).bit_count())
    both = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j]
    loose = [(i, j) for i, j in both if far(i, j)[0] <= 11 + S.LOOSE and sum(far(i, j)) <= 32]
    want = [(i, j) for i, j in loose if far(i, j)[0] <= 11]
    steps = [(place[r["a"]], place[r["b"]]) for r in every]
    found = [(place[r["a"]], place[r["b"]]) for r in every if r["d"] < S.LINK and r["rank"] <= most]
    assert len(steps) == len(set(steps)) and set(found) <= set(loose)
    joined = union(len(rows), steps)
    assert all(joined[i] == joined[j] for i, j in want)
    cramped, of = {place[r["a"]] for r in every if r["more"]}, Counter(i for i, _ in found)
    assert max(of.values()) <= most
    assert all((i, j) in set(found) for i, j in want if i not in cramped)
    if dense > 100:
        assert joined == union(len(rows), loose) and cramped <= {i for i, n in Counter(i for i, _ in loose).items() if n > most}


def test_links_between_classes_against_all_pairs(spark):
    rng = random.Random(12)
    base = [rng.getrandbits(62) for _ in range(100)]
    sets, open_ = [], []
    for node in range(90):
        family = base[:50] if node % 3 else base[50:]
        own = set(rng.sample(family, 44)) | {rng.getrandbits(62) for _ in range(rng.randrange(8))}
        sets.append((node, sorted(own)))
        open_.append((node, node % 2, node % 2 + (0 if node < 40 else node + 1) if node % 3 else 1000 + node))
    df = spark.createDataFrame(open_, "node long, span long, class long")
    own = spark.createDataFrame(sets, "text_hash long, shingles array<long>")
    alike = lambda i, j: 5 * len(set(sets[i][1]) & set(sets[j][1])) >= 4 * len(set(sets[i][1]) | set(sets[j][1]))
    same = [(i, j) for i in range(90) for j in range(i) if open_[i][1:] == open_[j][1:]]
    want = [(i, j) for i in range(90) for j in range(i) if open_[i][1] == open_[j][1] and alike(i, j)]
    for block in (4, 1000):
        found = [(r["a"], r["b"]) for r in S.links_between(df, own, 0.8, block).collect()]
        assert all(alike(i, j) for i, j in found) and union(90, same + found) == union(90, same + want)


def test_repeated_lines_hide_no_copy(spark):
    """A line repeated 3 to 300 times hardly changes a shingle set: all copies are one group."""
    rows, rng = [], random.Random(6)
    for base in range(3):
        text, line = words(rng, 300, 20_000), words(rng, 11, 20_000)
        rows += [(10 * base + i, f"{text} " + f"{line} " * k) for i, k in enumerate((1, 3, 10, 30, 300))]
    want = keepers_of(rows, lambda i, j: True)
    assert sorted(set(want.values())) == [0, 10, 20]
    assert {r["doc_id"]: r["keeper"] for r in S.similar_groups(docs_frame(spark, rows)).collect()} == want
