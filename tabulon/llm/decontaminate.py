"""Benchmark decontamination by spaced seeds.

One rule for items of any length: an overlap is an aligned stretch of at least 13 words, or of the whole item where that is
shorter, that begins and ends with an equal word and of whose words 80 % are equal; the longest for each document and item is
reported. (So an item of up to four words counts wherever it occurs unchanged, one of five with one word replaced inside.)

A mask ignores fixed positions of a word window; two windows that agree elsewhere share the mask's hash. The masks of ``MASKS``
together hit any overlap of 13 words or more. For shorter items the masks follow from their length: their ends and one of k + 1
parts of what lies between, where k words may be replaced. Hashes of the benchmark's windows form a table of bounded blocks; every
document's windows are looked up, and around each hit the two texts are laid side by side at that offset. Hits are verified
some at a time, so a phrase that very many items share costs time and not memory.

Edge cases: null texts and texts without words match nothing; very long ones are searched whole, in time linear in their length for each offset; items
and documents that repeat are reported each with its id; rows whose ids are null are compared like others; ties go to the
overlap with more equal words, then to the first in the document; an empty table on either side gives no rows; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import column_bytes, slices
from tabulon.llm.words import hash_words, mix

#: Positions that a mask looks at. In every stretch of 13 to 25 words that begins and ends with an equal word, one mask
#: finds a place free of substitutions if at most a fifth of the words are substituted, wherever they are.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 6, 9, 10), (0, 1, 3, 4, 6, 8), (0, 1, 3, 5, 6, 7))
LEAST = 13
SIMILARITY = 0.8
#: Hits that are verified at once.
_HITS = 1 << 20
#: Benchmark words that are held at once on an executor; a larger benchmark is compared block by block.
BLOCK_WORDS = 1 << 20
_BITS = 20
_OUT = "item_id long, doc_start long, doc_end long, item_start long, item_end long, n_equal long"


def seed_hashes(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The mask's hash at every start in ``words`` where it fits."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, np.uint64(sum(1 << p for p in mask)))
    for p in mask:
        out = mix(out ^ words[p : p + n])
    return out


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks for items of ``n`` words, fewer than ``LEAST``: with the n * (1 - ``SIMILARITY``) words that may differ, one stays clear."""
    spare = int(n * (1 - SIMILARITY) + 1e-9)
    if not spare:
        return [tuple(range(n))]
    inner = np.array_split(np.arange(1, n - 1), spare + 1)
    return [(0, *part.tolist(), n - 1) for part in inner]


@dataclass
class SeedTable:
    """Seeds of a block of items: sorted hashes, where each lies, and the items' words."""

    words: np.ndarray
    bounds: np.ndarray
    item_ids: list
    masks: list[tuple[int, ...]]
    hashes: list[np.ndarray]
    places: list[np.ndarray]
    filters: list[np.ndarray]

    @classmethod
    def of(cls, item_ids: list, texts: list[bytes]) -> SeedTable:
        words, bounds = hash_words(texts)
        sizes = np.diff(bounds)
        short = [m for n in np.unique(sizes).tolist() if 0 < n < LEAST for m in short_masks(n)]
        masks, hashes, places, filters = [*MASKS, *short], [], [], []
        for k, mask in enumerate(masks):
            fits = np.flatnonzero(sizes >= LEAST) if k < len(MASKS) else np.flatnonzero(sizes == mask[-1] + 1)
            found = [seed_hashes(words[bounds[i] : bounds[i + 1]], mask) for i in fits]
            h = np.concatenate([np.zeros(0, dtype=np.uint64), *found])
            at = np.concatenate([np.zeros(0, dtype=np.int64), *(bounds[i] + np.arange(len(f)) for i, f in zip(fits, found))])
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << _BITS, dtype=bool)
            seen[h >> np.uint64(64 - _BITS)] = True
            hashes.append(h[order])
            places.append(at[order])
            filters.append(seen)
        return cls(words, bounds, item_ids, masks, hashes, places, filters)

    def hits(self, words: np.ndarray, doc_of: np.ndarray):
        """(document, item, offset of the document's word against the item's) of all seeds that match; some at a time."""
        out, held = [], 0
        for k, mask in enumerate(self.masks):
            h = seed_hashes(words, mask)
            at = np.flatnonzero(self.filters[k][h >> np.uint64(64 - _BITS)])
            at = at[doc_of[at] == doc_of[at + mask[-1]]]  # windows don't cross documents
            first = np.searchsorted(self.hashes[k], h[at], "left")
            n = np.searchsorted(self.hashes[k], h[at], "right") - first
            at, first, n = at[n > 0], first[n > 0], n[n > 0]
            ends = np.cumsum(n)
            lo, total = 0, int(n.sum())
            while lo < total:  # the lo-th hit and the next ones, however they fall on positions
                nth = np.arange(lo, min(total, lo + _HITS))
                own = np.searchsorted(ends, nth, "right")
                place = self.places[k][first[own] + nth - (ends[own] - n[own])]
                item = np.searchsorted(self.bounds, place, "right") - 1
                out.append(np.stack([doc_of[at[own]], item, at[own] - (place - self.bounds[item])], axis=1))
                lo += len(nth)
                held += len(nth)
                if held >= _HITS:
                    yield np.unique(np.concatenate(out), axis=0)
                    out, held = [], 0
        if held:
            yield np.unique(np.concatenate(out), axis=0)

    def overlaps(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, ...]]:
        """(document, item, start and end in the document, start and end in the item, equal words): the longest for each pair."""
        doc_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        best: dict[tuple[int, int], tuple[int, ...]] = {}
        for hits in self.hits(words, doc_of):
            for doc, item, origin in hits.tolist():
                item_words = self.words[self.bounds[item] : self.bounds[item + 1]]
                lo, hi = max(origin, bounds[doc]), min(origin + len(item_words), bounds[doc + 1])
                equal = words[lo:hi] == item_words[lo - origin : hi - origin]
                found = longest_similar(equal, min(LEAST, len(item_words)))
                if found is None:
                    continue
                s, e = found
                rank = (int(e - s), int(equal[s:e].sum()), -int(lo + s))
                row = (int(lo + s - bounds[doc]), int(lo + e - bounds[doc]), int(lo - origin + s), int(lo - origin + e), rank[1])
                if (doc, item) not in best or rank > best[doc, item][0]:
                    best[doc, item] = (rank, row)
        return [(doc, item, *row) for (doc, item), (_, row) in sorted(best.items())]


def longest_similar(equal: np.ndarray, least: int) -> tuple[int, int] | None:
    """[start, end) of the longest stretch with at least ``SIMILARITY`` equal words that begins and ends with one; None below ``least``.

    Of several, the one with the most equal words, then the first. With an equal word worth 100 - 100 * ``SIMILARITY`` and another
    worth -100 * ``SIMILARITY``, a stretch is similar enough if its sum isn't negative: for each end, a search among the falling
    least prefix sums finds the first start.
    """
    ones = np.flatnonzero(equal)
    if not len(ones):
        return None
    share = round(100 * SIMILARITY)
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 100 - share, -share))])
    least_sums = np.minimum.accumulate(sums[ones])
    at = np.searchsorted(-least_sums, -sums[ones + 1], "left")  # the first start with a sum so small
    at = np.minimum(at, np.arange(len(ones)))
    length = ones + 1 - ones[at]
    fits = (sums[ones[at]] <= sums[ones + 1]) & (length >= least)
    if not fits.any():
        return None
    n = np.where(fits, length * (len(equal) + 1) + np.arange(len(ones)) - at + 1, -1)  # longest, then most equal words
    b = int(np.argmax(n))
    return int(ones[at[b]]), int(ones[b] + 1)


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS):
    """Blocks of (item ids, texts) with at most ``block_words`` bytes-of-text / 2, so words, each (one item at least)."""
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", "text").filter("text is not null").toLocalIterator():
        text = row["text"].encode()
        if texts and size + len(text) > 2 * block_words:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(text)
        size += len(text)
    if texts:
        yield ids, texts


def find_overlaps(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, doc_start, doc_end, item_start, item_end, n_equal`` in words: the longest overlap of each pair.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. Each block of the benchmark is one pass over ``docs``.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {_OUT}"

    def search(shared):
        def run(batches):
            table = shared.value
            for batch in slices(batches):
                texts, ids = column_bytes(batch.column(1)), batch.column(0).to_pylist()
                rows = [
                    (ids[doc], table.item_ids[item], *rest) for doc, item, *rest in table.overlaps(*hash_words(texts))
                ]
                columns = list(zip(*rows)) or [()] * 7
                types = [batch.schema.field(0).type, *[pa.int64()] * 6]
                names = ["doc_id", *(x.split()[0] for x in _OUT.split(", "))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        return run

    found = None
    for ids, texts in item_blocks(benchmark, block_words):
        table = spark.sparkContext.broadcast(SeedTable.of(ids, texts))  # bounded by block_words
        part = docs.select("doc_id", "text").mapInArrow(search(table), schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, all columns kept, in one pass for a benchmark of one block."""
    clean = docs
    for ids, texts in item_blocks(benchmark):
        table = docs.sparkSession.sparkContext.broadcast(SeedTable.of(ids, texts))
        clean = clean.mapInArrow(_keep(table, clean.columns.index("text")), clean.schema)
    return clean


def _keep(shared, at: int):
    def run(batches):
        table = shared.value
        for batch in slices(batches):
            hit = {doc for doc, *_ in table.overlaps(*hash_words(column_bytes(batch.column(at))))}
            yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every overlap of a document with a benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Every alignment of a document with an item, without seeds: pairs of equal words fix an offset, pairs of those a stretch.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents)
), i AS (
  SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS q, len(w) AS n
  FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark)
), e AS (
  SELECT doc_id, item_id, p, q, n, count(*) OVER (PARTITION BY doc_id, item_id, p - q) AS hits,
    row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS r
  FROM d JOIN i USING (word)
), c AS (SELECT * FROM e WHERE hits >= 0.8 * least(13, n)),
s AS (
  SELECT a.doc_id, a.item_id, a.p AS doc_start, b.p + 1 AS doc_end, a.q AS item_start, b.q + 1 AS item_end, b.r - a.r + 1 AS n_equal,
    row_number() OVER (PARTITION BY a.doc_id, a.item_id ORDER BY b.p - a.p DESC, b.r - a.r DESC, a.p) AS best
  FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND a.p - a.q = b.p - b.q AND b.p >= a.p
  WHERE b.p - a.p + 1 >= least(13, a.n) AND 5 * (b.r - a.r + 1) >= 4 * (b.p - a.p + 1)
)
SELECT doc_id, item_id, doc_start::BIGINT AS doc_start, doc_end::BIGINT AS doc_end, item_start::BIGINT AS item_start, item_end::BIGINT AS item_end,
  n_equal::BIGINT AS n_equal
FROM s WHERE best = 1
"""
