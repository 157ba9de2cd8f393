"""Language-model scores by deleted interpolation.

The model mixes four estimates of a token after the two before it: n(u, v, w) / n(u, v), n(v, w) / c(v), c(w) / N and 1 / (V + 1).
The weights depend on the frequencies of both contexts (powers of two of n(u, v), of eight of c(v); a text's first token has its own
weights) and are learnt by expectation-maximisation on deleted counts: each training event is predicted from the counts
without it. A sufficient table for that (bucket, three logarithmic ratios, events) is added up in the cluster; the driver sees
its cells only, whose number depends on the steps of the logarithms and not on the texts.

Every word, pair and triple has its own count over all training documents; nothing is pooled or broadcast. Texts are written once, in
batches. Each batch sends its distinct keys of each order, with their training counts, to the ranges of the hash space that
they fall into; a range adds the counts up and answers each batch with the totals, in the batch's own order. One message holds
one batch's run of keys in one range, compressed: there are never more messages than keys, and a key comes once from each
batch however often it occurs. The answers meet the batch's texts again, and the counts of all its tokens are written: learning
the weights and scoring are two plain scans of them. Keys of pairs and triples are hashes of ``SPARE_BITS`` bits more than the number of
tokens needs (64 at most), so that at any size about one key in 10**8 shares its hash with another; words keep 64 bits.

Edge cases: a null or empty text is its end token alone; a very long text is a batch of its own; without training tokens every token
has probability 1 / (V + 1) = 1; repeated rows are scored each for itself; null ids hash as the empty text; an empty table
gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import column_bytes, crc_mod, cut, distinct, distinct_counts, drop_cut, slices
from tabulon.llm.words import hash_words, mix

HOLD_OUT = 7, 2
#: Bytes of text in a batch, and in a range of the hash space (about).
BATCH_BYTES = 6 << 20
RANGE_BYTES = 8 << 20
SPARE_BITS = 27
#: Shuffle partitions that ranges or batches are dealt to, at most (each takes its ranges or batches one by one).
MOST_PARTITIONS = 16_384
#: Values from which on a message is compressed, and messages in one Arrow batch.
_PACKED = 64
_MESSAGES = 1024
#: Tokens in a row of counts, about (a longer text has a row of its own).
ROW_TOKENS = 1 << 18
#: Tokens, or keys of a range, that a step works on at once, and rows of texts in one Arrow batch.
_HELD = 1 << 16
_ARROW_ROWS = 1024
START = np.uint64(0x9E6C63D0876A9A47)
END = np.uint64(0x2545F4914F6CDD1D)
_ODD = np.uint64(0xD6E8FEB86659FD93)
#: Buckets: 64 powers of two of n(u, v) by 16 steps of c(v), and one for first tokens.
_STEPS, START_BUCKET, BUCKETS = 16, 64 * 16, 64 * 16 + 1
#: Ratios are told apart by steps of this factor's logarithm (base 2).
_STEP = 2


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token (words and an end each): its key, its text, and whether it comes first."""
    words, bounds = hash_words(texts)
    sizes = np.diff(bounds) + 1
    ends = np.cumsum(sizes)
    tokens = np.insert(words, bounds[1:], END)
    first = np.zeros(len(tokens), dtype=bool)
    first[ends - sizes] = True
    return tokens, np.repeat(np.arange(len(texts), dtype=np.int32), sizes), first


def orders_of(tokens: np.ndarray, first: np.ndarray, drop: int) -> Iterator[np.ndarray]:
    """The keys of the tokens, then of their pairs, then of the triples of all but first tokens; the last two end in ``drop`` zero bits.

    A first token's pair begins with the start of a text. One order at a time, some tokens at a time.
    """
    mask = np.uint64((1 << 64) - (1 << drop))
    yield tokens
    pairs = np.empty_like(tokens)
    for i in range(0, len(tokens), _HELD):
        own = slice(i, i + _HELD)
        before = np.concatenate([tokens[i - 1 : i] if i else [START], tokens[own][:-1]])
        before[first[own]] = START
        pairs[own] = mix(before * _ODD + tokens[own])
    yield pairs & mask
    triples = np.empty_like(tokens)
    for i in range(0, len(tokens), _HELD):
        own = slice(i, i + _HELD)
        before = np.concatenate([pairs[i - 1 : i] if i else [START], pairs[own][:-1]])
        triples[own] = mix(before * _ODD + mix(tokens[own])) & mask
    del pairs
    yield triples[~first]


def _ascending(keys: np.ndarray) -> Iterator[np.ndarray]:
    """Where the keys of each part of the hash space lie, part by part."""
    parts = (keys >> np.uint64(60)).astype(np.uint8)
    for part in range(16):
        yield np.flatnonzero(parts == part)


def training_counts(keys: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, and how often each is learnt."""
    found, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint32)]
    for at in _ascending(keys):
        own = keys[at]
        seen, n = distinct_counts(own[learnt[at]])
        found.append(distinct(own))
        counts.append(np.zeros(len(found[-1]), dtype=np.uint32))
        counts[-1][np.searchsorted(found[-1], seen)] = n
    return np.concatenate(found), np.concatenate(counts)


def _width(most: int) -> int:
    return max(1, (int(most).bit_length() + 7) // 8)


def _narrow(x: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of each value, in a row."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).ravel()


def _wide(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def pack(x: np.ndarray) -> bytes:
    """An array of unsigned integers as its byte planes, compressed where that pays; the first byte says how."""
    width = _width(x.max()) if len(x) else 1
    if len(x) < _PACKED:
        return bytes([width]) + _narrow(x, width).tobytes()
    import zstandard as zstd

    return bytes([width | 16]) + zstd.ZstdCompressor(level=1).compress(_narrow(x, width).reshape(-1, width).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    width = data[0] & 15
    if data[0] < 16:
        return _wide(data[1:], width)
    import zstandard as zstd

    raw = zstd.ZstdDecompressor().decompress(data[1:])
    return _wide(np.frombuffer(raw, np.uint8).reshape(width, -1).T.tobytes(), width)


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Which of ``ranges`` equal parts of the hash space each key lies in; ascending with the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def requests(order: int, keys: np.ndarray, counts: np.ndarray, ranges: int, drop: int) -> list[tuple[int, bytes, bytes]]:
    """Messages (part, keys, counts) of a batch's sorted distinct keys of one order; a part is a range of an order.

    Keys end in ``drop`` zero bits and are kept as differences.
    """
    at = range_of(keys, ranges)
    edges = np.append(np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])), len(keys)) if len(keys) else np.zeros(1, dtype=np.int64)
    parts = at[edges[:-1]].tolist()
    del at
    return [
        (order * ranges + part, pack(np.diff(keys[a:b] >> np.uint64(drop), prepend=np.uint64(0))), pack(counts[a:b]))
        for part, a, b in zip(parts, edges[:-1].tolist(), edges[1:].tolist())
    ]


def answer(messages: list[tuple[bytes, bytes]]) -> list[bytes]:
    """For each message (keys, counts) of one part: the counts that its keys have in all other messages.

    Keys are met some at a time, in their order; the unpacked messages and their answers are all that is held besides.
    """
    keys = [np.cumsum(unpack(k), dtype=np.uint64) for k, _ in messages]
    counts = [unpack(n) for _, n in messages]
    longest = max(keys, key=len)
    pieces = -(-sum(map(len, keys)) // _HELD)
    stops = longest[np.linspace(0, len(longest), pieces, endpoint=False, dtype=np.int64)[1:]]
    edges = [[0, *np.searchsorted(k, stops).tolist(), len(k)] for k in keys]
    for piece in range(pieces):
        at = [slice(e[piece], e[piece + 1]) for e in edges]
        own = np.concatenate([n[i] for n, i in zip(counts, at)])
        _, inverse = np.unique(np.concatenate([k[i] for k, i in zip(keys, at)]), return_inverse=True)
        total = np.zeros(int(inverse.max(initial=-1)) + 1, dtype=np.uint64)
        np.add.at(total, inverse, own)
        others = total[inverse] - own
        for n, i, part in zip(counts, at, np.split(others, np.cumsum([i.stop - i.start for i in at])[:-1])):
            n[i] = part
    return [pack(n) for n in counts]


def _grouped(batches):
    """Rows of each run of equal values in the first column (rows come sorted by it)."""
    held = []
    for batch in batches:
        for part in slices([batch], 1024):
            for row in zip(*(c.to_pylist() for c in part.columns)):
                if held and held[0][0] != row[0]:
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def _batches(rows):
    """(batch, ids, held, texts) of consecutive rows (doc_id, held_out, text); the same whenever a partition is read."""
    here, nth = TaskContext.get().partitionId() << 32, 0
    ids, held, texts, size = [], [], [], 0
    for batch in slices(rows, 256):
        for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), column_bytes(batch.column(2))):
            if texts and size + len(t) > BATCH_BYTES:
                yield here | nth, ids, held, texts
                ids, held, texts, size, nth = [], [], [], 0, nth + 1
            ids.append(i)
            held.append(bool(h))
            texts.append(t)
            size += len(t) + 1
    if texts:
        yield here | nth, ids, held, texts


def _texts(data: bytes, lengths: list[int]) -> list[bytes]:
    import zstandard as zstd

    raw, ends = zstd.ZstdDecompressor().decompress(data), np.cumsum(lengths).tolist()
    return [raw[e - n : e] for e, n in zip(ends, lengths)]


@contextmanager
def _short_batches(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile meets Python in Arrow batches of few rows; a setting of fewer stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before) if int(before) > 0 else _ARROW_ROWS, _ARROW_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def count_tokens(docs: DataFrame) -> DataFrame:
    """``ids, held, sizes, train_tokens, train_docs, n1, n2, n3``: training counts of each token, its pair and its triple.

    A row for each run of some ``docs`` (doc_id, held_out, text); the counts are compressed arrays over their tokens. A first
    token's triple has its pair's count.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)).first()[0] or 0
    ranges = max(1, -(-total // RANGE_BYTES))
    dealt = max(1, min(-(-total // BATCH_BYTES), MOST_PARTITIONS))
    drop = max(0, 64 - SPARE_BITS - int(total).bit_length())
    count_type = np.uint32 if total < 1 << 32 else np.uint64

    def send(rows):
        for batch, _, held, texts in _batches(rows):
            tokens, owner, first = tokens_of(texts)
            learnt = ~np.array(held)[owner]
            del owner
            for order, own in enumerate(orders_of(tokens, first, drop)):
                out = requests(order, *training_counts(own, learnt if order < 2 else learnt[~first]), ranges, drop if order else 0)
                for i in range(0, len(out), _MESSAGES):
                    part, keys, counts = zip(*out[i : i + _MESSAGES])
                    columns = [pa.array(part, pa.int64()), pa.array([batch] * len(part)), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "batch", "keys", "counts"])

    def carry(rows):
        import zstandard as zstd

        for batch, ids, held, texts in _batches(rows):
            data = zstd.ZstdCompressor(level=3).compress(b"".join(texts))
            columns = [[batch], [ids], [held], [[len(t) for t in texts]], [data]]
            kinds = (pa.int64(), list_type, pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["batch", "ids", "held", "lengths", "data"])

    def solve(rows):
        for group in _grouped(rows):
            columns = [[r[1] for r in group], [group[0][0]] * len(group), answer([r[2:] for r in group])]
            kinds = (pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["batch", "part", "data"])

    def meet(own: pa.Table, answers: pa.Table) -> pa.Table:
        _, ids, held, lengths, data = (own.column(i)[0].as_py() for i in range(5))
        tokens, owner, first = tokens_of(_texts(data, lengths))
        learnt = ~np.array(held)
        parts, values = answers.column(1).to_numpy(), answers.column(2).to_pylist()
        found = []
        for order, keys in enumerate(orders_of(tokens, first, drop)):
            in_order = sorted((int(p), i) for i, p in enumerate(parts) if p // ranges == order)
            others = np.concatenate([np.zeros(0, dtype=np.uint64), *(unpack(values[i]) for _, i in in_order)])
            known = learnt[owner] if order < 2 else learnt[owner[~first]]
            found.append(np.empty(len(keys), dtype=count_type))
            n = 0
            for at in _ascending(keys):
                own_keys, inverse = np.unique(keys[at], return_inverse=True)
                n += len(own_keys)
                if n > len(others):
                    break
                found[-1][at] = (others[n - len(own_keys) : n].astype(np.int64) + np.bincount(inverse[known[at]], minlength=len(own_keys)))[inverse]
            if n != len(others):
                raise ValueError(f"{len(others)} answers to the keys, of which there are {n} or more")
        n1, n2, later = found
        n3 = n2.copy()
        n3[~first] = later
        sizes = np.bincount(owner, minlength=len(ids))
        ends = np.cumsum(sizes)
        edges = np.unique(np.searchsorted(ends, np.arange(ROW_TOKENS, ends[-1], ROW_TOKENS), "right"))
        edges = [x for x in edges.tolist() if 0 < x < len(ids)]
        rows = []
        for a, b in zip([0, *edges], [*edges, len(ids)]):
            lo, hi = int(ends[a] - sizes[a]), int(ends[b - 1])
            known = learnt[a:b]
            rows.append((ids[a:b], held[a:b], sizes[a:b].tolist(), int(sizes[a:b][known].sum()), int(known.sum()), *(pack(n[lo:hi]) for n in (n1, n2, n3))))
        kinds = [list_type, pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), pa.int64(), *[pa.binary()] * 3]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=schema.names)

    # Written, so that its partitions hold the same rows in the same order at both readings.
    texts = cut(docs.select("doc_id", "held_out", "text"), "texts", "zstd")
    kind = T.ArrayType(docs.schema["doc_id"].dataType)
    list_type = to_arrow_type(kind)
    asked = texts.mapInArrow(send, "part long, batch long, keys binary, counts binary")
    asked = asked.repartition(min(3 * ranges, MOST_PARTITIONS), "part").sortWithinPartitions("part")
    with _short_batches(docs.sparkSession):
        answers = cut(asked.mapInArrow(solve, "batch long, part long, data binary"), "answers")
    schema = T.StructType([
        T.StructField("ids", kind), T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("train_tokens", T.LongType()), T.StructField("train_docs", T.LongType()),
        *(T.StructField(c, T.BinaryType()) for c in ("n1", "n2", "n3")),
    ])
    carried = T.StructType([T.StructField("batch", T.LongType()), *schema.fields[:2], T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType())])
    both = texts.mapInArrow(carry, carried).repartition(dealt, "batch").groupBy("batch")
    both = both.cogroup(answers.repartition(dealt, "batch").groupBy("batch"))
    with _short_batches(docs.sparkSession):
        counted = cut(both.applyInArrow(meet, schema), "counted")
    drop_cut(texts)
    drop_cut(answers)
    return counted


@dataclass
class Model:
    """Totals of the training tokens and the weights (triple, pair, word, uniform) of each bucket."""

    tokens: int
    types: int
    documents: int
    weights: np.ndarray


def contexts(n1: np.ndarray, n2: np.ndarray, first: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """How often the two tokens, and the one token, before each token have been seen; first tokens follow ``documents`` starts."""
    c3, c2 = (np.concatenate([[0], x[:-1]])[: len(x)].astype(np.int64) for x in (n2, n1))
    c3[first] = c2[first] = documents
    return c3, c2


def buckets(c3: np.ndarray, c2: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The weights' bucket of each token. A context that was never seen shares the bucket of those seen once: both say nothing."""
    log = lambda c: np.floor(np.log2(np.maximum(c, 1))).astype(np.int64)
    return np.where(first, START_BUCKET, log(c3) * _STEPS + np.minimum(log(c2) // 3, _STEPS - 1))


def _ratio(n: np.ndarray, c) -> np.ndarray:
    return np.where(c > 0, n / np.maximum(c, 1), 0.0)


def event_cells(n1, n2, n3, first, learnt, tokens: int, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells (bucket and the levels of the three deleted estimates, as one key) of the training events, and how many are in each."""
    c3, c2 = contexts(n1, n2, first, documents)
    n1, n2, n3, c3, c2, first = (x[learnt].astype(np.int64) for x in (n1, n2, n3, c3, c2, first))
    level = lambda p: np.where(p > 0, 1 + np.round(-np.log2(np.maximum(p, 1e-30)) * _STEP), 0).astype(np.int64)
    key = buckets(c3, c2, first.astype(bool))
    for n, c in ((n3, c3), (n2, c2), (n1, np.full(len(n1), tokens))):
        key = key << 8 | level(_ratio(n - 1, c - 1))
    return distinct_counts(key)


def learn_weights(cells: np.ndarray, events: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights of each bucket by expectation-maximisation; buckets without events have those of all events together."""
    if not len(cells):
        return np.tile([0.0, 0.0, 0.0, 1.0], (BUCKETS, 1))
    estimate = lambda level: np.where(level > 0, 2.0 ** (-(level - 1) / _STEP), 0)
    f = np.stack([*(estimate(cells >> s & 0xFF) for s in (16, 8, 0)), np.full(len(cells), uniform)], axis=1)

    def learn(bucket: np.ndarray, n: int) -> np.ndarray:
        out = np.tile([0.3, 0.3, 0.3, 0.1], (n, 1))
        for _ in range(rounds):
            share = f * out[bucket]
            share *= (events / share.sum(axis=1))[:, None]
            total = np.stack([np.bincount(bucket, weights=s, minlength=n) for s in share.T], axis=1)
            size = total.sum(axis=1, keepdims=True)
            out = np.where(size > 0, np.maximum(total / np.maximum(size, 1e-300), 1e-7), out)
            out /= out.sum(axis=1, keepdims=True)
        return out

    bucket = cells >> 24
    pooled = learn(np.zeros(len(cells), dtype=np.int64), 1)
    found = np.bincount(bucket, minlength=BUCKETS) > 0
    return np.where(found[:, None], learn(bucket, BUCKETS), pooled)


def _first(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(int(sizes.sum()), dtype=bool)
    out[np.cumsum(sizes) - sizes] = True
    return out


def fit(counted: DataFrame) -> Model:
    """The model of the training tokens in ``counted`` (see ``count_tokens``)."""
    tokens, documents = (x or 0 for x in counted.agg(F.sum("train_tokens"), F.sum("train_docs")).first())

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                held, sizes, *n = (batch.column(j)[i].as_py() for j in range(5))
                sizes = np.array(sizes)
                n1, n2, n3 = map(unpack, n)
                learnt = np.repeat(~np.array(held), sizes)
                cells, events = event_cells(n1, n2, n3, _first(sizes), learnt, tokens, documents)
                often, times = distinct_counts(n1[learnt].astype(np.int64))
                kind = np.repeat([False, True], [len(cells), len(often)])
                columns = [pa.array(kind), pa.array(np.concatenate([cells, often])), pa.array(np.concatenate([events, times]))]
                yield pa.RecordBatch.from_arrays(columns, ["word", "key", "n"])

    found = counted.select("held", "sizes", "n1", "n2", "n3").mapInArrow(run, "word boolean, key long, n long")
    found = cut(found.groupBy("word", "key").agg(F.sum("n").alias("n")), "cells")
    # Words that occur ``key`` times each have ``n`` tokens together.
    types = found.filter("word").agg(F.sum(F.expr("n div key"))).first()[0] or 0
    cells = found.filter("not word").toPandas()
    drop_cut(found)
    weights = learn_weights(cells["key"].to_numpy(dtype=np.int64), cells["n"].to_numpy(dtype=float), 1 / (types + 1))
    return Model(tokens, types, documents, weights)


def score_counted(counted: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each document of ``counted``."""
    from pyspark.sql.pandas.types import to_arrow_type

    shared = counted.sparkSession.sparkContext.broadcast(model)  # totals and one row of weights a bucket
    kind = counted.schema["ids"].dataType.elementType
    id_type = to_arrow_type(kind)

    def run(batches):
        m = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, held, sizes, *n = (batch.column(j)[i].as_py() for j in range(6))
                sizes = np.array(sizes)
                n1, n2, n3 = (unpack(x).astype(np.int64) for x in n)
                first, owner = _first(sizes), np.repeat(np.arange(len(sizes)), sizes)
                c3, c2 = contexts(n1, n2, first, m.documents)
                w = m.weights[buckets(c3, c2, first)]
                p = w[:, 0] * _ratio(n3, c3) + w[:, 1] * _ratio(n2, c2) + w[:, 2] * _ratio(n1, np.full(len(n1), m.tokens)) + w[:, 3] / (m.types + 1)
                sums = lambda x: np.bincount(owner, weights=x, minlength=len(ids))
                base = sums(np.log10((n1 + 1) / (m.tokens + m.types + 1)))
                columns = [
                    pa.array(ids, id_type), pa.array(held), pa.array(sizes), pa.array(sums(n1 > 0).astype(np.int64)),
                    pa.array(np.full(len(ids), m.tokens)), pa.array(base), pa.array(sums(np.log10(p))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return counted.select("ids", "held", "sizes", "n1", "n2", "n3").mapInArrow(run, schema)


def score(docs: DataFrame) -> DataFrame:
    """The scores of all rows of ``docs`` (doc_id, held_out, text) under the model of those that aren't held out."""
    counted = count_tokens(docs)
    return score_counted(counted, fit(counted))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document under the model of those whose crc32 remainder isn't 2."""
    held = crc_mod("doc_id", HOLD_OUT[0]) == HOLD_OUT[1]
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", held.alias("held_out"), "text"))


def base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that SQL can check, with a split that SQL can make: ids with a remainder of 2 by 7 are held out."""
    held = F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False))
    scored = score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", held.alias("held_out"), "text"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


BASE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(doc_id % 7 = 2, false) AS held_out, row_number() OVER () AS nth,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS t
  FROM documents
), e AS (SELECT doc_id, held_out, nth, unnest(t) AS token FROM w),
c AS (SELECT token, count(*) AS n FROM e WHERE NOT held_out GROUP BY token),
m AS (SELECT coalesce(sum(n), 0) AS tokens, count(*) AS types FROM c)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(n)::BIGINT AS n_known, any_value(tokens)::BIGINT AS train_tokens,
  round(sum(log10((coalesce(n, 0) + 1) / (tokens + 1 * (types + 1)))), 6) AS base_score
FROM e LEFT JOIN c USING (token), m GROUP BY doc_id, held_out, nth
"""
