import hashlib
import random

import numpy as np
import pytest
from fixtures import docs_frame, empty, mixed_rows, words
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.llm import repeats as R
from tabulon.llm.suffixes import permuted_prefixes, suffix_array


def plain_array(data):
    order = sorted(range(len(data)), key=lambda i: data[i:])
    shared = [0] * len(data)
    for a, b in zip(order, order[1:]):
        n = 0
        while max(a, b) + n < len(data) and data[a + n] == data[b + n]:
            n += 1
        shared[b] = n
    return order, shared


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=120), st.text("ab", max_size=150).map(str.encode), st.text("abc", max_size=20).map(lambda s: s.encode() * 6)))
def test_suffix_array(data):
    text = np.frombuffer(data, np.uint8)
    array = suffix_array(text)
    order, shared = plain_array(data)
    assert array.tolist() == order and permuted_prefixes(text, array).tolist() == shared


def covered(texts):
    """For each text, which bytes lie under a 200-byte string that starts in two places."""
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - R.LENGTH + 1):
            seen.setdefault(t[p : p + R.LENGTH], []).append((i, p))
    out = [np.zeros(len(t), dtype=bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                out[i][p : p + R.LENGTH] = True
    return out


def want(rows):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (doc, _), t, c in zip(rows, texts, covered(texts)):
        runs = int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum())
        left = np.frombuffer(t, np.uint8)[~c].tobytes()
        out.append((doc is None, doc or 0, len(t), int(c.sum()), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def planted():
    rng = random.Random(7)
    rows = mixed_rows(n=25)
    passage = words(rng, 70, 10_000)
    rows += [(200 + i, words(rng, 40, 10_000) + " " + passage + " " + words(rng, 30, 10_000)) for i in range(12)]
    rows += [(300, "abcdefghij" * 60), (301, "z" + "abcdefghij" * 41), (302, "ä" * 250 + passage[:210] + "ö" * 120), (303, passage[:199])]
    rows += [(310 + i, passage[i : 240 + i]) for i in range(5)] + [(320, words(rng, 100_000, 50))]
    return rows


@pytest.mark.parametrize("shard_bytes,hot", [(R.SHARD_BYTES, R.HOT), (3000, 3)])
def test_against_brute_force(spark, shard_bytes, hot):
    rows = planted()
    found = R.repeat_digest(docs_frame(spark, rows), shard_bytes, hot).collect()
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in found) == want(rows)


def test_anchors_cover_every_window():
    rng = random.Random(1)
    for data in (bytes(rng.randrange(97, 100) for _ in range(3000)), b"a" * 2000, b"abc" * 700, bytes(rng.randrange(256) for _ in range(2000))):
        at, _ = R.anchors(np.frombuffer(data, np.uint8))
        for p in range(len(data) - R.LENGTH + 1):
            assert any(p <= a <= p + R.LENGTH - R.GRAM for a in at[np.searchsorted(at, p) : np.searchsorted(at, p) + 1])
    assert len(R.anchors(np.frombuffer(b"a" * 20_000, np.uint8))[0]) < 1000


def test_remove_keeps_characters_and_columns(spark):
    rng = random.Random(2)
    passage = "ü" + words(rng, 60, 10_000) + "é"
    rows = [(1, "links ö" + passage + "ß rechts"), (2, "dort ÿ" + passage + "Ÿ"), (3, "allein"), (4, None), (5, passage * 2), (5, passage * 2)]
    df = docs_frame(spark, rows)
    out = R.remove_repeats(df)
    assert out.columns == df.columns
    left = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    texts = dict(left)
    assert texts[1].startswith("links") and texts[1].endswith("rechts") and passage[1:-1] not in texts[1]
    assert texts[3] == "allein" and texts[4] is None and texts[5] == "" and len(left) == 6


def test_empty(spark):
    assert R.repeat_digest(empty(spark)).count() == 0
    assert R.remove_repeats(empty(spark)).count() == 0
