"""Language identification by prediction by partial matching (PPM, escape method C) under frozen statistics.

For each language a tree of byte contexts of up to three bytes is counted on a bounded sample of labelled documents
(``SAMPLE_DOCS`` a language, whole texts of any length, chosen by hash; counted in the cluster). The code length of a
byte is -ln of its probability after the longest context that has it, plus an escape for each longer one that has been
seen without it: T + D events with D escapes after a context of T bytes with D distinct ones; below order 0 all 256
bytes are equally likely. With frozen statistics this is a function of four bytes, so the lengths of all quadruples seen in
training are tabulated and only others are computed anew. A text's language is the one with the shortest code.

Edge cases: a text that is null, empty or has no letter is ``und`` with score 0, as is every text where nothing was
learnt; a very long text is coded piece by piece, contexts running on; ties go to the alphabetically first language; repeated rows are treated alike; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import chunks_of, column_bytes, crc_mod, slices

ORDER = 3
SAMPLE_DOCS = 1000  # Spark cuts groups to so many rows before it deals them out, not to more
HOLD_OUT = 4, 2
_PIECE = 1 << 18
_COUNTED = 1 << 21
_SLOTS = 20
_MULTIPLIER = np.uint32(2654435769)


def quadruples(data: np.ndarray) -> np.ndarray:
    """For each byte from the fourth on: it and the three before it, as one uint32."""
    d = data.astype(np.uint32)
    return (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]


@dataclass
class ContextTree:
    """Counts of one language: for each order k, sorted (k + 1)-byte keys, and their contexts' totals and distinct bytes."""

    keys: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    distinct: list[np.ndarray]

    @classmethod
    def of(cls, quads: np.ndarray, counts: np.ndarray) -> ContextTree:
        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        for k in range(ORDER + 1):
            keys, where = np.unique(quads & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(where, weights=counts, minlength=len(keys))
            contexts, where = np.unique(keys >> np.uint32(8), return_inverse=True)
            totals = np.bincount(where, weights=n, minlength=len(contexts))
            distinct = np.bincount(where, minlength=len(contexts)).astype(float)
            for p, x in zip(parts, (keys, n, contexts, totals, distinct)):
                p.append(x)
        return cls(*parts)

    def lengths(self, quads: np.ndarray) -> np.ndarray:
        """Code length, in nats, of the last byte of each quadruple after the three before it."""
        cost, open_ = np.zeros(len(quads)), np.ones(len(quads), dtype=bool)
        for k in range(ORDER, -1, -1):
            key = quads & np.uint32((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(self.contexts[k], key >> np.uint32(8)), len(self.contexts[k]) - 1)
            known = open_ & (self.contexts[k][at] == key >> np.uint32(8))
            events = self.totals[k][at] + self.distinct[k][at]
            own = np.minimum(np.searchsorted(self.keys[k], key), len(self.keys[k]) - 1)
            seen = known & (self.keys[k][own] == key)
            cost[seen] -= np.log(self.counts[k][own][seen] / events[seen])
            escaped = known & ~seen
            cost[escaped] -= np.log(self.distinct[k][at][escaped] / events[escaped])
            open_ &= ~seen
        cost[open_] += np.log(256)
        return cost


@dataclass
class LanguageModel:
    """Trees by language; ``table`` holds the code lengths of every quadruple that any of them knows."""

    languages: list[str]
    trees: list[ContextTree]
    keys: np.ndarray = field(init=False)
    table: np.ndarray = field(init=False)
    slots: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        if not self.trees:
            return
        self.keys = np.unique(np.concatenate([t.keys[ORDER] for t in self.trees]))
        self.table = np.stack([t.lengths(self.keys) for t in self.trees], axis=1)
        use = np.zeros(len(self.keys))
        for t in self.trees:
            use[np.searchsorted(self.keys, t.keys[ORDER])] += t.counts[ORDER]
        by_use = np.argsort(use, kind="stable")
        self.slots = np.zeros(1 << _SLOTS, dtype=np.int32)
        self.slots[self._slot(self.keys[by_use])] = by_use  # the most used last, so that it stays

    @staticmethod
    def _slot(quads: np.ndarray) -> np.ndarray:
        return (quads * _MULTIPLIER) >> np.uint32(32 - _SLOTS)

    def lengths(self, quads: np.ndarray) -> np.ndarray:
        """A row for each quadruple, a column for each language."""
        at = self.slots[self._slot(quads)]
        out = self.table[at]
        miss = np.flatnonzero(self.keys[at] != quads)
        if len(miss):
            others, where = np.unique(quads[miss], return_inverse=True)
            at = np.minimum(np.searchsorted(self.keys, others), len(self.keys) - 1)
            found = self.table[at]
            new = self.keys[at] != others
            if new.any():
                found[new] = np.stack([t.lengths(others[new]) for t in self.trees], axis=1)
            out[miss] = found[where]
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Total code length of each text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        for lo, hi in chunks_of(texts, _PIECE):
            if hi - lo == 1 and len(texts[lo]) > _PIECE:
                padded = bytes(ORDER) + texts[lo]
                for i in range(0, len(texts[lo]), _PIECE):
                    quads = quadruples(np.frombuffer(padded[i : i + _PIECE + ORDER], np.uint8))
                    out[lo] += self.lengths(quads).sum(axis=0, dtype=np.float64)
                continue
            sizes = np.array([len(t) for t in texts[lo:hi]])
            some = np.flatnonzero(sizes)
            if not len(some):
                continue
            data = np.frombuffer(b"".join(bytes(ORDER) + texts[lo + i] for i in some), np.uint8)
            ends = np.cumsum(sizes[some] + ORDER)
            starts = ends - sizes[some]  # of the texts in data; their quadruples begin ORDER earlier in quads
            costs = self.lengths(quadruples(data)).astype(np.float64)
            bounds = np.stack([starts - ORDER, ends - ORDER], axis=1).ravel()
            costs = np.vstack([costs, np.zeros((1, costs.shape[1]))])
            out[lo + some] = np.add.reduceat(costs, bounds, axis=0)[::2]
        return out


def _count(batches):
    for batch in slices(batches):
        langs, texts = batch.column(0).to_pylist(), column_bytes(batch.column(1))
        for lang in sorted(set(langs)):
            for quads in _pieces([bytes(ORDER) + t for x, t in zip(langs, texts) if x == lang and t]):
                keys, n = np.unique(quads, return_counts=True)
                columns = [pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "quad", "n"])


def _pieces(texts: list[bytes]):
    """All quadruples within each of ``texts``, some ``_COUNTED`` at a time."""
    for lo, hi in chunks_of(texts, _COUNTED):
        if hi - lo == 1:
            for i in range(0, len(texts[lo]) - ORDER, _COUNTED):
                yield quadruples(np.frombuffer(texts[lo][i : i + _COUNTED + ORDER], np.uint8))
        else:
            yield np.concatenate([quadruples(np.frombuffer(t, np.uint8)) for t in texts[lo:hi]])


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """``docs`` (doc_id, text, lang): the rows to learn from; null languages are ignored."""
    rows = docs.filter(F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    # A share of each language's rows, some three times the sample, is ranked; a common language is no large group.
    shares = rows.groupBy(F.col("lang").alias("l")).agg((3.0 * sample_docs / F.count("*")).alias("share"))
    key = F.xxhash64("doc_id", F.lit(11))
    ids = rows.select("doc_id", "lang", F.octet_length("text").alias("n"), key.alias("key")).join(F.broadcast(shares), F.col("lang") == F.col("l"))
    ids = ids.filter(F.pmod("key", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    by_hash = Window.partitionBy("l").orderBy("key", "doc_id", "n")
    ids = ids.withColumn("r", F.row_number().over(by_hash)).filter(F.col("r") <= sample_docs).select("doc_id", "l", "n").distinct()
    chosen = rows.join(
        F.broadcast(ids),
        rows["doc_id"].eqNullSafe(ids["doc_id"]) & (rows["lang"] == ids["l"]) & (F.octet_length(rows["text"]) == ids["n"]),
        "left_semi",
    )
    counted = chosen.select("lang", "text").mapInArrow(_count, "lang string, quad long, n long")
    found = counted.groupBy("lang", "quad").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    trees = []
    for lang in languages:
        own = found[found["lang"] == lang]
        trees.append(ContextTree.of(own["quad"].to_numpy().astype(np.uint32), own["n"].to_numpy(dtype=float)))
    return LanguageModel(languages, trees)


def classify(model: LanguageModel, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    """The language of each text and its posterior; ``und`` and 0 without a letter."""
    import regex

    if not model.trees:
        return ["und"] * len(texts), np.zeros(len(texts))
    letter = regex.compile(r"\p{L}")
    costs = model.code_lengths(texts)
    best = costs.argmin(axis=1)
    odds = np.exp(-np.clip(costs - costs.min(axis=1, keepdims=True), 0, 700))
    real = np.array([bool(t) and letter.search(t.decode("utf-8", "replace")) is not None for t in texts], dtype=bool)
    return [model.languages[i] if ok else "und" for i, ok in zip(best, real)], np.where(real, 1 / odds.sum(axis=1), 0.0)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` (among them text) with ``lang_pred`` and ``score``, the posterior of the language found.

    A table's own columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches):
            names, score = classify(shared.value, column_bytes(batch.column(at)))
            columns = [pa.array(names, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows whose language is known with a posterior of ``least`` or more; columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches):
            names, score = classify(shared.value, column_bytes(batch.column(at)))
            yield batch.filter(pa.array([x != "und" and s >= least for x, s in zip(names, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: language of every document, learnt from the rows whose crc32 remainder isn't 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = crc_mod("doc_id", HOLD_OUT[0]) == HOLD_OUT[1]
    model = fit(docs.filter(~held))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
