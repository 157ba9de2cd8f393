"""Packing of token sequences by minimum bin slack.

Each document's ids (with the end id) are cut at multiples of the window; whole windows are sequences of their own.
What remains of each document is packed by its length alone: the driver holds a histogram of remaining lengths (fewer entries
than the window has tokens, at any input size). A pattern takes the longest length left and then, by a
subset-sum dynamic program over bit sets with bounded counts, the multiset that fills the window closest to its
capacity; counts are found by tracking back through the bit sets. A pattern is used as often as the histogram allows. In
the cluster, remainders are ranked within their length (by hashed blocks, so a common length is no hot group) and look up
which use of which pattern their rank falls into.

Edge cases: a null or empty text is the end id alone; a very long one is tokenised whole and leaves one checksum for each window;
equal lengths are ranked by id and place; null ids rank first; repeated rows are packed each for itself; an empty table gives no
pieces; extra columns are ignored.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.common import cut, slices

WINDOW = 2048
END_ID = 1
#: Blocks in which equal lengths are ranked, at least, and the pieces that one of them has, about.
BLOCKS = 64
BLOCK_PIECES = 500_000
_TOKENIZED = "doc_tokens long, crcs array<long>"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed public vocabulary lies; the same ids as byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Strings that byte_bpe_50k.json has as added tokens, which its reader finds in any text.
ADDED = {"<|endoftext|>": 50256}


@functools.cache
def encoder(path: str):
    """Byte-level BPE over the ranks in ``path``; ``encode_ordinary`` takes the strings of ``ADDED`` as ordinary text."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)


def text_ids(encoding, text: str) -> list[int]:
    """The ids of ``text`` as byte_bpe_50k.json's reader gives them with add_special_tokens=False."""
    if any(x in text for x in ADDED):
        return encoding.encode(text, allowed_special=set(ADDED))
    return encoding.encode_ordinary(text)


def piece_crcs(ids: np.ndarray, window: int) -> list[int]:
    """crc32 of each window of little-endian uint32 ids."""
    data = memoryview(ids.astype("<u4").tobytes())
    return [zlib.crc32(data[i : i + 4 * window]) for i in range(0, len(data), 4 * window)]


def tokenize(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """``doc_id, doc_tokens, crcs`` (one for each window of the document's ids)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoding = encoder(path or vocabulary_path())
        for batch in slices(batches):
            sizes, crcs = [], []
            for text in batch.column(1).to_pylist():
                ids = np.array([*text_ids(encoding, text or ""), end_id], dtype=np.uint32)
                sizes.append(len(ids))
                crcs.append(piece_crcs(ids, window))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc_tokens", "crcs"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_TOKENIZED}")


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length make the sum closest to ``capacity`` without passing it (bounded subset sum).

    Lengths are taken up from the longest; each is split into powers of two, one bit-set shift each. The search stops
    once the capacity is reached.
    """
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= capacity), reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left -= take
            take *= 2
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often each is used, until every remainder is placed."""
    left, patterns = {x: n for x, n in histogram.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fill(left, window - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        uses = min(left[x] // n for x, n in chosen.items())
        for x, n in chosen.items():
            left[x] -= n * uses
            if not left[x]:
                del left[x]
        patterns.append((chosen, uses))
    return patterns


def _segments(patterns: list[tuple[dict[int, int], int]]) -> tuple[list[tuple[int, ...]], int]:
    """For each pattern and length: ranks [first, last), pieces a use, first sequence, first offset in the sequence."""
    rows, used, sequence = [], {}, 0
    for chosen, uses in patterns:
        offset = 0
        for length, n in sorted(chosen.items(), reverse=True):
            first = used.get(length, 0)
            rows.append((length, first, first + n * uses, n, sequence, offset))
            used[length] = first + n * uses
            offset += length * n
        sequence += uses
    return rows, sequence


def _ranked(pieces: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Adds ``rank``: from 0 within ``keys``, counted in hashed blocks first; ``total`` is the number of pieces, about."""
    blocks = max(BLOCKS, -(-total // BLOCK_PIECES))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "crc", "doc_tokens", "start"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.groupBy(*keys, "block").agg(F.count("*").alias("n"))
    starts = starts.select(*keys, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy(*keys, "block").orderBy("doc_id", "start", "crc", "doc_tokens")
    return pieces.withColumn("in_block", F.row_number().over(own) - 1).join(starts, [*keys, "block"]).withColumn(
        "rank", F.col("base") + F.col("in_block")
    )


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for every piece of ``docs``."""
    spark = docs.sparkSession
    tokens = cut(tokenize(docs, window, end_id, path), "tokens")  # tokenised once, read twice
    rest = F.col("doc_tokens") % window
    counted = tokens.groupBy(rest.cast("int").alias("length")).agg(
        F.count("*").alias("n"), F.sum(F.floor(F.col("doc_tokens") / window)).alias("whole")
    )
    counted = counted.collect()  # a row for each remaining length: ``window`` at most
    histogram = {r["length"]: r["n"] for r in counted if r["length"]}
    rows, sequences = _segments(plan(histogram, window))
    pieces = tokens.select("doc_id", "doc_tokens", F.posexplode("crcs").alias("at", "crc")).select(
        "doc_id",
        (F.col("at").cast("long") * window).alias("start"),
        F.least(F.lit(window).cast("long"), F.col("doc_tokens") - F.col("at") * window).alias("length"),
        "crc",
        "doc_tokens",
    )
    out = ["doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens"]
    whole = _ranked(pieces.filter(F.col("length") == window).withColumn("all", F.lit(0)), ["all"], sum(r["whole"] for r in counted)).select(
        *out, (F.col("rank") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    schema = "seg_length long, first long, last long, each long, sequence long, base_offset long"
    segments = spark.createDataFrame(rows, schema)
    parts = _ranked(pieces.filter(F.col("length") < window), ["length"], sum(histogram.values()))
    place = F.col("rank") - F.col("first")
    found = (F.col("length") == F.col("seg_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    packed = parts.join(F.broadcast(segments), found).select(  # segments: bounded by the window, not by the input
        *out,
        (F.col("sequence") + F.floor(place / F.col("each"))).alias("sequence_id"),
        (F.col("base_offset") + place % F.col("each") * F.col("length")).alias("offset"),
    )
    return whole.unionByName(packed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all documents packed into sequences of 2048 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
