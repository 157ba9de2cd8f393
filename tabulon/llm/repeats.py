"""Removal of long byte strings that occur more than once, by suffix arrays over shards.

A 200-byte string that occurs twice contains, wherever it occurs, an anchor chosen from its own bytes alone: the 24-byte gram with
the least hash. Anchors whose gram occurs in one place only can't lie in a repeated string, so only the bytes around the others
(176 before, 200 after the anchor's start) go on, to the shard that the gram's hash names. A shard holds all places
where its grams occur; its suffix array (induced sorting, ``suffixes``) and permuted common prefixes show every 200-byte
string that starts in two places. Identical surroundings enter the array once, with a note that they occur twice.

A gram with more than ``HOT`` places would make one shard too large. Its windows (at most 177 for a place) are compared by
128-bit hashes in an aggregation that Spark combines before it shuffles: the same rows, at any count.

Edge cases: a null text is empty and is never removed from; texts under 200 bytes stay whole; very long ones are read in overlapping pieces; copies of a text of at least 200
bytes (repeated rows among them) lose everything; matches never cross documents; an empty table gives no rows; extra columns
are kept by ``remove_repeats`` and ignored by ``repeat_digest``. A helper column's name gives way to the table's own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import chunks_of, column_bytes, cut, drop_cut, slices
from tabulon.llm.suffixes import permuted_prefixes, suffix_array
from tabulon.llm.words import mix

LENGTH = 200
GRAM = 24
#: Bytes in one suffix array, about (all places of one gram stay together).
SHARD_BYTES = 2 << 20
#: Places of one gram beyond which its windows are compared by hash.
HOT = 10_000
#: Parts into which the places of one window are dealt.
SALTS = 16
_PIECE = 1 << 19
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (1, 2, 4, 8)]


def gram_hashes(data: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of the 24 bytes from each position on."""
    d = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1))[data]
    for k, power in enumerate(_POWERS[:3]):
        d = d[: -(1 << k)] * power + d[1 << k :]
    return mix((d[:-16] * _POWERS[3] + d[8:-8]) * _POWERS[3] + d[16:])


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every run of ``width`` values."""
    step, left = 1, width
    out = x
    while step * 2 <= left:
        out = pick(out[:-step], out[step:])
        step *= 2
    return pick(out[: len(out) - (width - step)], out[width - step :]) if step < width else out


def anchors(data: np.ndarray, valid: np.ndarray | None = None, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of anchors: each ``length`` bytes of ``data`` have one that only depends on them.

    ``valid`` marks the grams that count (those that don't cross from one document into the next). Among equal grams, close
    together, the first and last of each stretch of half a window are enough.
    """
    width = length - GRAM + 1
    if len(data) < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    full = gram_hashes(data)
    h = (full >> np.uint64(32)).astype(np.uint32)
    if valid is not None:
        h[~valid[: len(h)]] = np.uint32(0xFFFFFFFF)
    least = _sliding(h, width, np.minimum)
    padded = np.concatenate([np.zeros(width - 1, dtype=np.uint32), least, np.zeros(width - 1, dtype=np.uint32)])
    chosen = h == _sliding(padded, width, np.maximum)
    if valid is not None:
        chosen &= valid[: len(h)]
    at = np.flatnonzero(chosen)
    hashes = full[at]
    same = np.concatenate([[False], hashes[1:] == hashes[:-1]])
    if same.any():
        run = np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
        stretch = (at - at[run]) // (width // 2)
        new = ~same | np.concatenate([[True], stretch[1:] != stretch[:-1]])
        keep = new | np.concatenate([new[1:], [True]])
        at, hashes = at[keep], hashes[keep]
    return at, hashes


def text_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's index, position, hash) of the anchors of all texts."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo, hi in chunks_of(texts, _PIECE):
        if hi - lo == 1 and len(texts[lo]) > _PIECE:
            data = np.frombuffer(texts[lo], np.uint8)
            parts = [(i, *anchors(data[i : i + _PIECE + LENGTH])) for i in range(0, len(data), _PIECE)]
            at = np.concatenate([i + p for i, p, _ in parts])
            at, first = np.unique(at, return_index=True)
            out.append((np.full(len(at), lo), at, np.concatenate([h for _, _, h in parts])[first]))
            continue
        data = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
        ends = np.cumsum([len(t) for t in texts[lo:hi]])
        valid = np.ones(len(data), dtype=bool)
        for e in ends.tolist():
            valid[max(0, e - GRAM + 1) : e] = False
        at, h = anchors(data, valid)
        owner = np.searchsorted(ends, at, "right")
        starts = np.concatenate([[0], ends[:-1]])
        out.append((owner + lo, at - starts[owner], h))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of [start, end) spans, as maximal runs in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[first], reach[np.concatenate([first[1:], [True]])]


def shard_spans(owners: np.ndarray, starts: np.ndarray, pieces: list[bytes], length: int = LENGTH):
    """(index of the piece, start, end in its document) of all bytes under a ``length``-byte string that starts in two places.

    ``owners`` and ``starts`` say which document each piece comes from and where it begins there; pieces may overlap.
    """
    index: dict[bytes, int] = {}
    content = np.array([index.setdefault(p, len(index)) for p in pieces], dtype=np.int64)
    bodies = list(index)
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    where = np.stack([content, owners, starts], axis=1)
    distinct = np.unique(where, axis=0)
    places = np.bincount(distinct[:, 0], minlength=len(bodies))
    first = np.full(len(bodies), len(pieces), dtype=np.int64)
    np.minimum.at(first, content, np.arange(len(pieces)))
    several = places > 1
    out = []
    whole = np.flatnonzero(several[content] & (sizes[content] >= length))
    out.append((whole, starts[whole], starts[whole] + sizes[content[whole]]))
    text = np.frombuffer(b"".join(bodies), np.uint8)
    array = suffix_array(text).astype(np.int64)
    shared = permuted_prefixes(text, array)
    begins = np.cumsum(sizes) - sizes
    body = np.repeat(np.arange(len(bodies)), sizes)
    group = np.cumsum(shared[array] < length)
    fits = (begins[body] + sizes[body] - np.arange(len(text)) >= length)[array]
    at, group = array[fits], group[fits]
    if len(at):
        b = body[at]
        place = (owners[first[b]] << np.int64(40)) + starts[first[b]] + at - begins[b]
        cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        repeated = (np.minimum.reduceat(place, cuts) != np.maximum.reduceat(place, cuts)) | np.logical_or.reduceat(several[b], cuts)
        hit = np.sort(at[np.repeat(repeated, np.diff(np.append(cuts, len(at))))])
        hit = hit[~several[body[hit]]]
        if len(hit):
            b = body[hit]
            new = np.concatenate([[True], (hit[1:] - hit[:-1] > length) | (b[1:] != b[:-1])])
            last = np.concatenate([new[1:], [True]])
            piece = first[b[new]]
            shift = starts[piece] - begins[b[new]]
            out.append((piece, hit[new] + shift, hit[last] + length + shift))
    return tuple(np.concatenate(x) for x in zip(*out))


_SPANS = "tkey binary, start long, end long"


def _key(text: Column) -> Column:
    """By which texts are told apart: half of their SHA-256."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(text.alias("text"), _key(text).alias("tkey")).filter(F.octet_length("text") >= LENGTH)


def _find_anchors(batches):
    for batch in slices(batches):
        keys = batch.column(1)
        owner, at, h = text_anchors(column_bytes(batch.column(0)))
        columns = [keys.take(pa.array(owner)), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["tkey", "pos", "hash"])


def _squeeze(batches):
    import zstandard as zstd

    for batch in slices(batches):
        c = zstd.ZstdCompressor(level=1)
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([c.compress(t) for t in column_bytes(batch.column(0))])], ["tkey", "z"])


def _texts(column) -> list[bytes]:
    import zstandard as zstd

    d = zstd.ZstdDecompressor()
    return [d.decompress(z) for z in column.to_pylist()]


def _around(batches):
    """The surroundings of each anchor that isn't hot."""
    for batch in slices(batches):
        keys, places = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        rows = []
        for key, text, at in zip(keys, _texts(batch.column(1)), places):
            for p in at:
                if not p["hot"]:
                    start = max(0, p["pos"] - (LENGTH - GRAM))
                    rows.append((p["hash"], key, start, text[start : p["pos"] + LENGTH]))
        for i in range(0, len(rows), 4000):
            h, k, s, t = zip(*rows[i : i + 4000])
            columns = [pa.array(h, pa.int64()), pa.array(k, pa.binary()), pa.array(s, pa.int64()), pa.array(t, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["hash", "tkey", "start", "piece"])


def _search(shard_bytes: int):
    def run(batches):
        def found(rows):
            keys = [r[1] for r in rows]
            index: dict[bytes, int] = {}
            owners = np.array([index.setdefault(k, len(index)) for k in keys], dtype=np.int64)
            piece, start, end = shard_spans(owners, np.array([r[2] for r in rows], dtype=np.int64), [r[3] for r in rows])
            columns = [pa.array([keys[i] for i in piece.tolist()], pa.binary()), pa.array(start), pa.array(end)]
            return pa.RecordBatch.from_arrays(columns, ["tkey", "start", "end"])

        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= shard_bytes and row[0] != held[-1][0]:
                    yield found(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield found(held)

    return run


def _hot_windows(batches):
    """128-bit hashes of all windows around hot anchors."""
    for batch in slices(batches):
        keys, places = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        if not any(p["hot"] for at in places for p in at):
            continue
        for key, text, at in zip(keys, _texts(batch.column(1)), places):
            starts: set[int] = set()
            for p in at:
                if p["hot"]:
                    starts.update(range(max(0, p["pos"] - (LENGTH - GRAM)), min(p["pos"], len(text) - LENGTH) + 1))
            order = sorted(starts)
            digests = [hashlib.blake2b(text[s : s + LENGTH], digest_size=16).digest() for s in order]
            columns = [pa.array(digests, pa.binary()), pa.array([key] * len(order), pa.binary()), pa.array(order, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["window", "tkey", "start"])


def _merge_into(texts: bool):
    """Bytes removed, runs and digest of each text; with ``texts`` also what is left, cut between characters only."""

    def run(batches):
        for batch in slices(batches):
            rows = []
            for key, text, spans in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), batch.column(2).to_pylist()):
                starts, ends = merge_spans(
                    np.array([s["start"] for s in spans], dtype=np.int64), np.array([s["end"] for s in spans], dtype=np.int64)
                )
                data = np.frombuffer(text, np.uint8)
                left = _without(text, starts, ends)
                row = (key, int((ends - starts).sum()), len(starts), hashlib.sha256(left).hexdigest())
                if texts:
                    starts, ends = whole_characters(data, starts, ends)
                    row += (_without(text, starts, ends).decode(),)
                rows.append(row)
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()][: 4 + texts]
            names = ["tkey", "n_removed", "n_spans", "kept_sha256", "kept"][: 4 + texts]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def _without(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def whole_characters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans shrunk to whole UTF-8 characters."""
    inside = np.append((data & 0xC0) == 0x80, False)
    starts, ends = starts.copy(), ends.copy()
    for _ in range(3):
        starts += inside[starts]
        ends -= inside[ends]
    keep = starts < ends
    return starts[keep], ends[keep]


def repeat_spans(docs: DataFrame, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Distinct texts with a repeated gram (tkey, z, at), and spans (tkey, start, end) of repeated strings between them."""
    texts = _keyed(docs)
    # Written: found once, and a plain side of the join below, which Spark can split where a gram is very common.
    found = cut(texts.mapInArrow(_find_anchors, "tkey binary, pos int, hash long"), "anchors")
    place = F.xxhash64("tkey", "pos")
    repeated = (
        found.groupBy("hash")
        .agg(F.min(place).alias("least"), F.max(place).alias("most"), F.count("*").alias("n"))
        .filter("least <> most")
        .select("hash", (F.col("n") > hot).alias("hot"))
    )
    positions = found.join(repeated, "hash").distinct().groupBy("tkey").agg(F.collect_list(F.struct("pos", "hash", "hot")).alias("at"))
    small = texts.mapInArrow(_squeeze, "tkey binary, z binary").dropDuplicates(["tkey"])
    candidates = cut(small.join(positions, "tkey"), "candidates")
    drop_cut(found)
    total = candidates.agg(F.sum(F.size("at").cast("long"))).first()[0] or 0
    shards = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-total * (2 * LENGTH - GRAM) // (8 * SHARD_BYTES)))
    pieces = candidates.mapInArrow(_around, "hash long, tkey binary, start long, piece binary")
    spans = pieces.repartition(int(shards), "hash").sortWithinPartitions("hash").mapInArrow(_search(shard_bytes), _SPANS)
    windows = candidates.mapInArrow(_hot_windows, "window binary, tkey binary, start long")
    spot = F.xxhash64("tkey", "start")
    twice = windows.groupBy("window").agg(F.min(spot).alias("least"), F.max(spot).alias("most")).filter("least <> most")
    salted = twice.select("window", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = windows.withColumn("salt", F.pmod(spot, F.lit(SALTS)).cast("int"))  # a window may be in very many places
    by_hash = dealt.join(salted, ["window", "salt"]).select("tkey", "start", (F.col("start") + LENGTH).alias("end"))
    return candidates, spans.unionByName(by_hash)


def _results(docs: DataFrame, texts: bool, shard_bytes: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """By tkey: what is removed from each text that shares a part with another, and the keys of texts that have copies."""
    candidates, spans = repeat_spans(docs, shard_bytes, hot)
    by_text = spans.groupBy("tkey").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    schema = "tkey binary, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * texts
    parts = candidates.select("tkey", "z").join(by_text, "tkey").mapInArrow(_merge_into(texts), schema)
    copies = _keyed(docs).groupBy("tkey").agg(F.count("*").alias("n")).filter("n > 1").select("tkey", F.lit(True).alias("copied"))
    return parts, copies


def repeat_digest(docs: DataFrame, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    parts, copies = _results(docs, False, shard_bytes, hot)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), _key(text).alias("tkey"), F.sha2(text, 256).alias("own"))
    joined = rows.join(parts, "tkey", "left").join(copies, "tkey", "left")
    gone = F.col("copied").isNotNull()
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "own")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """``docs`` with repeated strings cut out of its texts (whole characters only); other columns as they are."""
    parts, copies = _results(docs, True, shard_bytes, hot)
    key = "tkey"
    while key in docs.columns:
        key += "_"
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.withColumn(key, _key(text)).alias("d")
    joined = rows.join(parts.select(F.col("tkey").alias("k1"), "kept").alias("p"), F.col(f"d.{key}") == F.col("p.k1"), "left")
    joined = joined.join(copies.select(F.col("tkey").alias("k2"), "copied").alias("c"), F.col(f"d.{key}") == F.col("c.k2"), "left")
    left = F.when(F.col("c.copied"), F.lit("")).otherwise(F.coalesce(F.col("p.kept"), F.col("d.text")))
    return joined.select(*(left.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: what repeated 200-byte strings leave of each document."""
    return repeat_digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: Every window by its md5, on hexadecimal text, two digits a byte.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS p FROM d WHERE length(h) >= 400)),
r AS (SELECT doc_id, p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM r),
n AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
s AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM n GROUP BY doc_id, run),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM s GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""
