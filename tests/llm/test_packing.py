import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from fixtures import docs_frame, empty, mixed_rows, words
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabulon.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = ["", "a", "Hello  world\n\n it's  fine ", "é ñ ü ß 漢字 🙂", "<|endoftext|> x", "x" * 3000, " \t\r\n ", "1234 5,6", "ﬁ́   z"]


def test_same_ids_as_the_json_vocabulary(tokenizer):
    """The reader as it is loaded, its added token among the texts."""
    encoding = packing.encoder(packing.vocabulary_path())
    for text in TEXTS:
        assert packing.text_ids(encoding, text) == tokenizer.encode(text, add_special_tokens=False).ids


PARTS = st.one_of(st.text(max_size=20), st.sampled_from(["<|endoftext|>", "<|", " ", "\n", "endoftext|>"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=6).map("".join))
def test_same_ids_on_any_text(tokenizer, text):
    assert packing.text_ids(packing.encoder(packing.vocabulary_path()), text) == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 60))
def test_fill_is_the_best_subset_sum(counts, capacity):
    chosen = packing.fill(counts, capacity)
    assert all(n <= counts[x] for x, n in chosen.items())
    sums = {0}
    for x, n in counts.items():
        sums = {s + x * k for s in sums for k in range(n + 1)}
    assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= capacity)


def test_plan_places_everything():
    rng = random.Random(0)
    histogram = Counter(rng.randrange(1, 100) for _ in range(3000))
    patterns = packing.plan(dict(histogram), 100)
    used = Counter()
    for chosen, uses in patterns:
        assert sum(x * n for x, n in chosen.items()) <= 100
        for x, n in chosen.items():
            used[x] += n * uses
    assert used == histogram
    assert sum(u for _, u in patterns) <= 1.01 * sum(x * n for x, n in histogram.items()) / 100 + 1


def test_pieces_round_trip(spark, tokenizer):
    rng = random.Random(4)
    rows = mixed_rows() + [(2000, words(rng, 4000)), (2001, words(rng, 9000))]
    found = packing.pack(docs_frame(spark, rows), window=64).collect()
    want = Counter()
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for a in range(0, len(ids), 64):
            piece = ids[a : a + 64]
            want[i, a, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == want
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(sequences) == list(range(len(sequences)))
    total = sum(r["length"] for r in found)
    assert len(sequences) <= -(-total // 64) + 3


def test_empty(spark):
    assert packing.pack(empty(spark)).count() == 0


@pytest.fixture(scope="module")
def contract():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_added_tokens_as_the_contract_reads_them(spark, contract):
    """The tokenizer as it is loaded: add_special_tokens=False does not turn added tokens off."""
    assert {t.content: i for i, t in contract.get_added_tokens_decoder().items()} == packing.ADDED
    mark = "<|endoftext|>"
    texts = [*TEXTS, f"hello {mark} world", mark, mark * 3, f"a  {mark}  \n\n{mark}b", f"it{mark}'s", "<|endoftext|", f"é 🙂{mark}漢字 {mark[:-1]}"]
    want = {i: contract.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert want[len(TEXTS)] == [31373, 220, 50256, 995]
    encoding = packing.encoder(packing.vocabulary_path())
    assert {i: packing.text_ids(encoding, t) for i, t in enumerate(texts)} == want
    found = packing.tokenize(docs_frame(spark, list(enumerate(texts)))).collect()
    crc = lambda ids: packing.piece_crcs(np.array([*ids, packing.END_ID]), packing.WINDOW)
    assert {r["doc_id"]: (r["doc_tokens"], r["crcs"]) for r in found} == {i: (len(x) + 1, crc(x)) for i, x in want.items()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from(["<|endoftext|>", " ", "\n", "<|", "|>"])), max_size=8).map("".join))
def test_text_ids_on_any_text(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.text_ids(packing.encoder(packing.vocabulary_path()), text) == t.encode(text, add_special_tokens=False).ids
