"""Quality by compression: a dictionary of good and one of bad labelled text, the size difference, a calibrated score.

Fitting takes a bounded sample of the labelled rows (``SAMPLE_DOCS`` a class, texts of any length, chosen by hash). One half of
it builds two zstandard dictionaries, from blocks spread evenly over each text (``TEXT_BLOCKS`` of a text and ``SAMPLE_BLOCKS``
of a class at most); the other half, whole texts compressed in the cluster, calibrates: a monotone curve from the size
difference to the probability of label 1, reweighted to the shares that all training labels have. A text is
compressed in blocks under both dictionaries, so that the dictionaries matter in long texts as much as in short
ones; (bad - good) / (bad + good) over the summed sizes is the only input of the score.

Edge cases: an empty or null text has difference 0; a very long text is compressed block by block like any other; a label that is
null is ignored; a document with several labels counts with its lowest; where one class has no labels the score is the
smoothed share of label 1; rows that repeat an id and a text are scored alike and learnt from once; extra columns are ignored, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.common import column_bytes, crc_mod, cut, drop_cut, slices

SAMPLE_DOCS = 1500
TEXT_BLOCKS = 64
SAMPLE_BLOCKS = 8192
#: Small, so that a dictionary holds what a class has in common rather than single texts.
DICT_BYTES = 16_384
BLOCK = 512
LEVEL = 3
THRESHOLD = 0.3
HOLD_OUT = 5


def blocks_of(text: bytes, size: int = BLOCK) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


class Sizer:
    """Compressed sizes of a text under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as zstd

        self.compressors = []
        for raw in (good, bad):
            shared = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_AUTO)
            shared.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstd.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_dict_id=False, write_checksum=False)
            )

    def difference(self, text: bytes) -> float:
        """(bad - good) / (bad + good): above 0 if the good dictionary serves better."""
        if not text:
            return 0.0
        good, bad = (sum(len(c.compress(b)) for b in blocks_of(text)) for c in self.compressors)
        return (bad - good) / (bad + good)


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Weighted one-variable logistic regression (Newton, a slight ridge on the slope)."""
    scale = float(np.std(x)) or 1.0
    z, a, b = x / scale, 0.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
        g = np.array([np.sum(w * (y - p) * z) - 1e-3 * a, np.sum(w * (y - p))])
        v = np.maximum(w * p * (1 - p), 1e-9)
        h = np.array([[np.sum(v * z * z) + 1e-3, np.sum(v * z)], [np.sum(v * z), np.sum(v)]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a + float(step[0]), b + float(step[1])
        if float(np.abs(step).max()) < 1e-9:
            break
    return a / scale, b


def fit_monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression (pool adjacent violators): the ends of each level stretch and its height."""
    values, where = np.unique(x, return_inverse=True)
    weight = np.bincount(where, weights=w)
    height = np.bincount(where, weights=w * y) / weight
    pools: list[list[float]] = []  # first value, last value, height, weight
    for v, h, n in zip(values.tolist(), height.tolist(), weight.tolist()):
        pools.append([v, v, h, n])
        while len(pools) > 1 and pools[-2][2] >= pools[-1][2]:
            _, last, h2, n2 = pools.pop()
            first, _, h1, n1 = pools[-1]
            pools[-1] = [first, last, (h1 * n1 + h2 * n2) / (n1 + n2), n1 + n2]
    return np.array([v for p in pools for v in p[:2]]), np.array([p[2] for p in pools for _ in p[:2]])


@dataclass
class QualityModel:
    """Dictionaries and calibration; ``good`` is None where only the prior is known.

    The score is the monotone fit, read linearly between its stretches, with a thousandth of the logistic curve, which
    keeps texts on one stretch in order.
    """

    good: bytes | None
    bad: bytes | None
    slope: float
    intercept: float
    at: np.ndarray | None = None
    height: np.ndarray | None = None

    def score(self, differences: np.ndarray) -> np.ndarray:
        curve = 1 / (1 + np.exp(-np.clip(self.slope * differences + self.intercept, -35, 35)))
        if self.at is None:
            return curve
        return 0.999 * np.interp(differences, self.at, self.height) + 0.001 * curve


def build_dictionary(blocks: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained zstandard dictionary; where the trainer has too little, the raw blocks serve as one."""
    import zstandard as zstd

    total = sum(map(len, blocks))
    try:
        return zstd.train_dictionary(min(size, max(1024, total // 8)), blocks).as_bytes()
    except zstd.ZstdError:
        return b"".join(blocks)[-size:] or b" "


def spread_blocks(text: bytes, most: int = TEXT_BLOCKS) -> list[bytes]:
    """At most ``most`` blocks of ``text``, evenly spread over all of it."""
    count = -(-len(text) // BLOCK)
    picked = range(count) if count <= most else [i * count // most for i in range(most)]
    return [text[i * BLOCK : (i + 1) * BLOCK] for i in picked]


def _build_blocks(batches):
    for batch in slices(batches):
        for q, text in zip(batch.column(0).to_pylist(), column_bytes(batch.column(1))):
            found = spread_blocks(text)
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(found), pa.int32()), pa.array(found, pa.binary())], ["quality", "block"])


def sample(docs: DataFrame, labels: DataFrame, sample_docs: int) -> tuple[DataFrame, int, int]:
    """``quality, role, text`` of the sampled rows (role 0 builds, 1 calibrates), and how many labels of 0 and 1 there are."""
    one = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"))
    )
    counts = {r["quality"]: r["n"] for r in one.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    mark = F.xxhash64("text")
    found = one.join(docs.filter(F.octet_length("text") > 0).select("doc_id", mark.alias("mark")), "doc_id").distinct()
    by_hash = [F.xxhash64("doc_id", F.lit(7)), F.col("doc_id"), F.col("mark")]
    picked = [found.filter(F.col("quality") == c).orderBy(*by_hash).limit(sample_docs) for c in (0, 1)]
    turn = F.row_number().over(Window.partitionBy("quality").orderBy(*by_hash))
    chosen = picked[0].unionByName(picked[1]).withColumn("role", turn % 2)  # at most 2 * sample_docs rows
    rows = docs.join(F.broadcast(chosen), (docs["doc_id"] == chosen["doc_id"]) & (mark == chosen["mark"]))
    rows = rows.select(docs["doc_id"], "quality", "role", "text").dropDuplicates(["doc_id", "text"])
    return cut(rows.select("quality", "role", "text"), "sample"), counts.get(0, 0), counts.get(1, 0)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_blocks: int = SAMPLE_BLOCKS) -> QualityModel:
    """``docs`` (doc_id, text) and ``labels`` (doc_id, quality) of the training rows."""
    rows, n0, n1 = sample(docs, labels, sample_docs)
    prior = QualityModel(None, None, 0.0, math.log((n1 + 1) / (n0 + 1)))
    blocks = rows.filter("role = 0").select("quality", "text").mapInArrow(_build_blocks, "quality int, block binary")
    order = [F.xxhash64("block"), F.col("block")]
    build = [[bytes(r["block"]) for r in blocks.filter(F.col("quality") == c).orderBy(*order).limit(sample_blocks).collect()] for c in (0, 1)]
    if not (build[0] and build[1]):
        return prior
    bad, good = map(build_dictionary, build)
    shared = docs.sparkSession.sparkContext.broadcast((good, bad))

    def measure(batches):
        sizer = Sizer(*shared.value)
        for batch in slices(batches):
            found = [sizer.difference(t) for t in column_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["quality", "difference"])

    tune = rows.filter("role = 1").select("quality", "text").mapInArrow(measure, "quality int, difference double").collect()
    drop_cut(rows)
    tune = sorted((r["difference"], r["quality"]) for r in tune)  # at most 2 * sample_docs numbers
    x, y = np.array([d for d, _ in tune]), np.array([q for _, q in tune], dtype=float)
    if len(set(y.tolist())) < 2:
        return prior
    share = [n0 / (n0 + n1) / np.sum(y == 0), n1 / (n0 + n1) / np.sum(y == 1)]
    w = np.where(y == 1, share[1], share[0]) * len(y)
    return QualityModel(good, bad, *fit_logistic(x, y, w), *fit_monotone(x, y, w))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score`` of every row (columns doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        sizer = Sizer(m.good, m.bad) if m.good is not None else None
        for batch in slices(batches):
            texts = column_bytes(batch.column(1))
            found = np.array([sizer.difference(t) if sizer else 0.0 for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.score(found))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: quality of every document, learnt from the rows whose crc32 remainder isn't 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held = crc_mod("doc_id", HOLD_OUT) == 0
    model = fit(docs.filter(~held), labels.filter(~held))
    return score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
