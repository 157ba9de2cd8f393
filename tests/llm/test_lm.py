import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from fixtures import empty, mixed_rows, words
from pyspark.sql import functions as F

from tabulon.llm import lm


def frame(spark, rows):
    return spark.createDataFrame([(i, bool(h), t, 1, "x", 2) for i, h, t in rows], "doc_id long, held_out boolean, text string, range int, word string, batch int")


def tokens(text):
    return [*(text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split(), None]


def rows_of(n=80):
    rng = random.Random(3)
    rows = [(i, i % 5 == 0, words(rng, rng.randrange(1, 80), 60)) for i in range(n)]
    return rows + [(i, False, t) for i, t in mixed_rows(n=10)] + [(5000, True, "new words only"), (5001, True, None)]


def plain_scores(rows, weights):
    """The mixture, token by token, with plain dictionaries."""
    train = [tokens(t) for _, h, t in rows if not h]
    c = Counter(w for d in train for w in d)
    total, types = sum(c.values()), len(c)
    pairs, triples = Counter(), Counter()
    for d in train:
        for i, w in enumerate(d):
            pairs[d[i - 1] if i else "<start>", w] += 1
            if i:
                triples[d[i - 2] if i > 1 else "<start>", d[i - 1], w] += 1
    out = []
    for i, h, t in rows:
        d, score = tokens(t), 0.0
        for j, w in enumerate(d):
            if j:
                u, v = d[j - 2] if j > 1 else "<start>", d[j - 1]
                c3, c2, n3, n2 = pairs[u, v], c[v], triples[u, v, w], pairs[v, w]
                bucket = int(math.log2(max(c3, 1))) * 16 + min(15, int(math.log2(max(c2, 1))) // 3)
            else:
                c3 = c2 = len(train)
                n3 = n2 = pairs["<start>", w]
                bucket = 1024
            a, b, g, z = weights[bucket]
            score += math.log10(a * n3 / max(c3, 1) + b * n2 / max(c2, 1) + g * c[w] / total + z / (types + 1))
        base = sum(math.log10((c[w] + 1) / (total + types + 1)) for w in d)
        out.append((i, h, len(d), sum(c[w] > 0 for w in d), total, base, score))
    return out


@pytest.mark.parametrize("batch,part", [(6 << 20, 8 << 20), (900, 700)])
def test_against_plain_counts(spark, monkeypatch, batch, part):
    monkeypatch.setattr(lm, "BATCH_BYTES", batch)
    monkeypatch.setattr(lm, "RANGE_BYTES", part)
    monkeypatch.setattr(lm, "ROW_TOKENS", batch // 10)
    rows = rows_of()
    counted = lm.count_tokens(frame(spark, rows))
    model = lm.fit(counted)
    train = [tokens(t) for _, h, t in rows if not h]
    assert (model.tokens, model.documents) == (sum(map(len, train)), len(train))
    assert model.types == len({w for d in train for w in d})
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    found = sorted((tuple(r) for r in lm.score_counted(counted, model).collect()), key=key)
    want = sorted(plain_scores(rows, model.weights), key=key)
    assert [r[:5] for r in found] == [w[:5] for w in want]
    np.testing.assert_allclose([r[5:] for r in found], [w[5:] for w in want], rtol=1e-9)


def test_messages_round_trip():
    rng = np.random.default_rng(0)
    for ranges, drop in ((1, 0), (3, 9), (1000, 0), (1 << 20, 3)):
        mask = np.uint64((1 << 64) - (1 << drop))
        batches = [np.unique((rng.integers(0, 2**64, 500, dtype=np.uint64) >> np.uint64(s)) & mask) for s in (0, 1, 40)]
        batches = [np.unique(np.concatenate([b, batches[0][:100]])) for b in batches]
        counts = [rng.integers(0, 9, len(b)).astype(np.uint64) for b in batches]
        rows = [(i, *m) for i, (b, c) in enumerate(zip(batches, counts)) for m in lm.requests(2, b, c, ranges, drop)]
        assert len(rows) <= sum(map(len, batches))
        total = Counter()
        for b, c in zip(batches, counts):
            total.update(dict(zip(b.tolist(), c.tolist())))
        got = {0: [], 1: [], 2: []}
        for part in sorted({r[1] for r in rows}):
            group = [r for r in rows if r[1] == part]
            for row, v in zip(group, lm.answer([r[2:] for r in group])):
                got[row[0]].append(lm.unpack(v))
        for i, (b, c) in enumerate(zip(batches, counts)):
            assert (np.concatenate(got[i]) + c).tolist() == [total[k] for k in b.tolist()]


def peak_mb(make):
    tracemalloc.start()
    try:
        make()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_a_step_holds_little_besides_its_arrays():
    rng = np.random.default_rng(2)
    found = [np.unique(rng.integers(0, 2**40, 50_000, dtype=np.uint64)) for _ in range(20)]
    messages = [(lm.pack(np.diff(k, prepend=np.uint64(0))), lm.pack(np.ones(len(k), dtype=np.uint64))) for k in found]
    assert peak_mb(lambda: lm.answer(messages)) < 30  # keys and counts alone: 15
    tokens, first = rng.integers(0, 2**64, 1_000_000, dtype=np.uint64), rng.random(1_000_000) < 0.01
    known = rng.random(1_000_000) < 0.9
    steps = lambda: [len(lm.training_counts(k, known if len(k) == len(known) else known[~first])[0]) for k in lm.orders_of(tokens, first, 9)]
    assert peak_mb(steps) < 60  # tokens, pairs and triples alone: 23


def test_training_counts():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5000):
        keys, learnt = lm.mix(rng.integers(0, 300, n).astype(np.uint64)), rng.random(n) < 0.5
        own, counts = lm.training_counts(keys, learnt)
        want = Counter(keys[learnt].tolist())
        assert own.tolist() == sorted(set(keys.tolist())) and counts.tolist() == [want[k] for k in own.tolist()]


def test_packed_arrays_round_trip():
    for x in ([], [0], [1, 255, 256], [2**64 - 1, 3], [*range(1000)], [7] * 64 + [2**40]):
        a = np.array(x, dtype=np.uint64)
        assert np.array_equal(lm.unpack(lm.pack(a)), a)


def test_texts_that_occur_twice_stand_apart(spark):
    rng = random.Random(5)
    rows = [(i, False, words(rng, 60, 50)) for i in range(200)]
    rows += [(1000 + i, False, rows[i][2]) for i in range(20)]
    per_token = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm.score(frame(spark, rows)).collect()}
    twice = [per_token[i] for i in range(20)]
    once = [per_token[i] for i in range(20, 200)]
    assert min(twice) > max(once)


def test_held_out_texts_beat_the_base(spark):
    rng = random.Random(1)
    rows = [(i, i % 5 == 0, " ".join(f"a{(j := rng.randrange(20))} b{j} c{j}" for _ in range(30))) for i in range(100)]
    out = lm.score(frame(spark, rows)).filter("held_out").collect()
    assert len(out) == 20 and all(r["score"] > r["base_score"] for r in out)


def test_weights_are_shares():
    rng = np.random.default_rng(0)
    cells = np.array([(3 << 24) | (a << 16) | (b << 8) | c for a in (0, 9) for b in (0, 13) for c in (13, 25)])
    weights = lm.learn_weights(cells, rng.integers(50, 500, len(cells)).astype(float), 1e-3)
    assert weights.shape == (lm.BUCKETS, 4) and np.allclose(weights.sum(axis=1), 1) and (weights > 0).all()


def test_no_training_and_empty(spark):
    df = frame(spark, [(1, True, "a b"), (2, True, None)])
    out = {r["doc_id"]: r for r in lm.score(df).collect()}
    assert out[1]["base_score"] == 0 and out[1]["n_known"] == 0 and out[1]["n_tokens"] == 3 and out[1]["score"] == 0
    assert lm.score(empty(spark).select("doc_id", F.lit(True).alias("held_out"), "text")).count() == 0
