"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit set where over half of the shingles' XXH64 hashes have it (repeated shingles count each time). Distinct fingerprints are looked up
in one table for each segment of their bits: a fingerprint sends its own segment value to the table and, as a probe, every
value in a small Hamming ball around it. If two fingerprints differ in at most r bits, some segment differs in no more
than its ball's radius (``segments``), so no link is lost. Each table entry's fingerprints are verified on all 64 bits by a search
that links what it reaches, so an entry of n fingerprints gives fewer than n links, never all pairs; entries with very many
fingerprints are dealt on to the tables of finer segments. Links go through distributed components.

The pipeline's stage (``similar_groups``) compares shingle sets; see there. It tells texts apart by 128 bits (``text_keys``).

Edge cases: null texts count as empty; very long ones are hashed whole, some shingles at a time; texts without words have fingerprint zero and link to one another like any others;
texts with fewer words than a shingle are one shingle; repeated rows share a class; null ids never name a component
unless no member has an id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.common import column_bytes, cut, distinct, drop_cut, slices
from tabulon.llm.graph import components
from tabulon.llm.words import mix

WORDS = 4
RADIUS = 4
SEED = 42
#: Shingles whose hashes are held at once.
_HELD = 1 << 15
#: Fingerprints of one table entry that are searched together; above, the entry is split.
ENTRY = 20_000
#: The stage on shingle sets: bits of both fingerprints, bits of the first beyond the radius of the tables, candidates that a text
#: takes, rows of a dense entry that are searched together, rows held at once, and nodes of a block with the words of their sketches.
TOTAL = 32
LOOSE = 7
NEAREST = 6
PIECE = 2048
ENTRY_ROWS = 1 << 20
BLOCK = 2048
SKETCH = 16
#: Bytes of text from which on the stage works in rounds: texts are dealt to one part for so many, and ``PARTS`` parts at most.
PART_BYTES = 1 << 30
PARTS = 8
#: A distance beyond all: such rows only say what hangs together.
LINK = 255
_ODD = 0x9E3779B97F4A7C15
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    from xxhash import xxh64_intdigest

    found = text.translate(_LOWER).split()
    if len(found) <= words:
        return np.array([xxh64_intdigest(b" ".join(found), seed)] if found else [], dtype=np.uint64)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    pairs = zip((ends - sizes).tolist(), ends[words - 1 :].tolist())
    return np.fromiter((xxh64_intdigest(joined[i:j], seed) for i, j in pairs), np.uint64, len(found) - words + 1)


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The text's 64-bit fingerprint."""
    return int(sketch(shingle_hashes(text, words, seed), 1)[0])


def sketch(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` fingerprints of 64 bits of a set of hashes, each from a hash of its own."""
    out = np.zeros(size, dtype=np.uint64)
    for k in range(size):
        hashes = shingles if k == 0 else mix(shingles + np.uint64(k * _ODD % 2**64))
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, len(hashes), _HELD):
            part = hashes[i : i + _HELD].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


def _with_columns(docs: DataFrame, names: list[str], make) -> DataFrame:
    """All columns but text, and one long column for each of ``names`` from ``make`` (a text's bytes to that many uint64)."""
    at = docs.columns.index("text")
    kept = [i for i in range(len(docs.columns)) if i != at]

    def run(batches):
        for batch in slices(batches):
            found = np.array([make(t) for t in column_bytes(batch.column(at))], dtype=np.uint64).reshape(-1, len(names))
            columns = [batch.column(i) for i in kept]
            columns += [pa.array(np.ascontiguousarray(found[:, k]).view(np.int64)) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, [*(batch.schema.names[i] for i in kept), *names])

    fields = [docs.schema.fields[i] for i in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{n} long" for n in names)])
    return docs.mapInArrow(run, schema)


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """All columns but text, and ``fp`` (the fingerprint's bits as a signed long); repeated shingles count each time."""
    return _with_columns(docs, ["fp"], lambda t: [fingerprint(t, words, seed)])


def set_fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """All columns but text, and ``fp`` and ``fp2``, two fingerprints of the text's set of shingles."""
    return _with_columns(docs, ["fp", "fp2"], lambda t: sketch(distinct(shingle_hashes(t, words)), 2))


def segments(radius: int, count: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(first bit, width, ball radius) of each of ``count`` segments.

    With radius = count * q + a, the first a + 1 segments get balls of radius q and the others of q - 1: were all
    of them exceeded, the distance would be at least (a + 1)(q + 1) + (count - a - 1) q = radius + 1. A radius of -1 (q = 0)
    needs no table.
    """
    q, a = divmod(radius, count)
    widths = [bits // count + (i >= count - bits % count) for i in range(count)]
    out, first = [], 0
    for i, width in enumerate(widths):
        ball = q if i <= a else q - 1
        if ball >= 0:
            out.append((first, width, ball))
        first += width
    return out


def ball(width: int, radius: int) -> np.ndarray:
    """Every mask of up to ``radius`` of ``width`` bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], dtype=np.uint64)


def choose_segments(n: int, radius: int) -> int:
    """The number of segments with the least work: rows sent, and a five-hundredth of that for each fingerprint compared."""
    def work(count: int) -> float:
        return sum(len(ball(w, r)) * (1 + 0.002 * n / 2.0**w) for _, w, r in segments(radius, count))

    return min(range(2, max(3, min(radius, 8) + 1)), key=work)


def entries(fps: np.ndarray, radius: int, count: int, only: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table keys, whether the entry is a probe, and the index of its fingerprint, for all ``fps``; of ``only`` one table if given."""
    keys, probes, owners = [], [], []
    for s, (first, width, r) in enumerate(segments(radius, count)):
        if only not in (None, s):
            continue
        own = (fps >> np.uint64(first)) & np.uint64((1 << width) - 1)
        tag = np.uint64(s << 58)
        keys.append(own | tag)
        probes.append(np.zeros(len(fps), dtype=bool))
        owners.append(np.arange(len(fps)))
        masks = ball(width, r)[1:]  # the fingerprint's own value is met as an entry
        keys.append(((own[:, None] ^ masks[None, :]) | tag).ravel())
        probes.append(np.ones(len(fps) * len(masks), dtype=bool))
        owners.append(np.repeat(np.arange(len(fps)), len(masks)))
    return np.concatenate(keys), np.concatenate(probes), np.concatenate(owners)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def reach(fps: np.ndarray, stored: np.ndarray, radius: int, second: np.ndarray | None = None, total: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links that join every two of ``fps`` that a chain of pairs within ``radius`` joins, where one of each pair is stored.

    With ``second`` fingerprints, both together lie within ``total`` bits too. A search from each fingerprint not reached yet: what it links is not compared with later ones again.
    """
    open_ = np.arange(len(fps))
    froms, tos = [], []
    while len(open_):
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            at = queue.pop()
            bits = _popcount(fps[open_] ^ fps[at])
            near = bits <= radius
            if second is not None:
                near &= bits + _popcount(second[open_] ^ second[at]) <= total
            if not stored[at]:
                near &= stored[open_]
            if near.any():
                hit = open_[near]
                froms.append(np.full(len(hit), at))
                tos.append(hit)
                queue.extend(hit.tolist())
                open_ = open_[~near]
    if not froms:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(froms), np.concatenate(tos)


def split_search(fps: np.ndarray, stored: np.ndarray, radius: int, most: int = ENTRY) -> tuple[np.ndarray, np.ndarray]:
    """``reach`` for an entry of any size: beyond ``most`` fingerprints, by the tables of finer segments of all bits."""
    if len(fps) <= most:
        return reach(fps, stored, radius)
    keys, probes, owners = entries(fps, radius, 2)
    order = np.argsort(keys, kind="stable")
    keys, probes, owners = keys[order], probes[order], owners[order]
    cuts = np.flatnonzero(np.diff(keys, prepend=keys[0] ^ np.uint64(1)))
    froms, tos = [], []
    for lo, hi in zip(cuts, [*cuts[1:], len(keys)]):
        if hi - lo > 1 and not probes[lo:hi].all():
            own, first = np.unique(owners[lo:hi], return_index=True)
            a, b = reach(fps[own], ~probes[lo:hi][first], radius)
            froms.append(own[a])
            tos.append(own[b])
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *froms]), np.concatenate([empty, *tos])


def _search_groups(keys: np.ndarray, fps: np.ndarray, probes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys (rows sorted by key)."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    entry = np.add.reduceat((~probes).astype(np.int64), starts)
    froms, tos = [], []
    # Entries with one stored fingerprint and few probes: compare at once.
    simple = (entry == 1) & (sizes > 1)
    if simple.any():
        member = np.repeat(simple, sizes)
        k, f, p = np.repeat(np.arange(len(starts)), sizes)[member], fps[member], probes[member]
        owner = np.zeros(len(starts), dtype=np.uint64)
        owner[k[~p]] = f[~p]
        near = p & (_popcount(owner[k] ^ f) <= radius) & (owner[k] != f)
        froms.append(owner[k][near])
        tos.append(f[near])
    for g in np.flatnonzero((entry > 1) & (sizes > 1)):
        own = slice(starts[g], starts[g] + sizes[g])
        a, b = split_search(fps[own], ~probes[own], radius)
        froms.append(fps[own][a])
        tos.append(fps[own][b])
    empty = np.zeros(0, dtype=np.uint64)
    return np.concatenate([empty, *froms]), np.concatenate([empty, *tos])


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links between the distinct ``fp`` of ``prints`` that join all within ``radius`` bits, each chain once.

    A table entry with over ``ENTRY_ROWS`` fingerprints, more than one task should hold, is dealt on to the tables of both halves of
    their bits.
    """
    n = prints.count()
    count = choose_segments(n, radius)

    def explode(batches):
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(all_fps), 2000):
                fps = all_fps[i : i + 2000]
                keys, probes, owners = entries(fps, radius, count)
                columns = [pa.array(keys.view(np.int64)), pa.array(fps[owners].view(np.int64)), pa.array(probes)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "fp", "probe"])

    def search(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def found(parts, last):
            keys, fps, probes = (np.concatenate(x) for x in zip(*parts))
            stop = len(keys) if last else int(np.searchsorted(keys, keys[-1]))
            a, b = _search_groups(keys[:stop], fps[:stop], probes[:stop], radius) if stop else (keys[:0], keys[:0])
            links_ = np.unique(np.stack([a, b], axis=1).view(np.int64), axis=0)
            out = pa.RecordBatch.from_arrays([pa.array(links_[:, 0]), pa.array(links_[:, 1])], ["a", "b"])
            return out, [(keys[stop:], fps[stop:], probes[stop:])] if not last else []

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held.append((columns[0], columns[1].view(np.uint64), columns[2]))
            size += batch.num_rows
            if size >= 1 << 18 and held[0][0][0] != held[-1][0][-1]:
                out, held = found(held, False)
                size = sum(len(x[0]) for x in held)
                yield out
        if size:
            yield found(held, True)[0]

    def deal_on(batches):
        for batch in batches:
            key, fp = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2))
            for i in range(0, batch.num_rows, 500):
                fps = fp[i : i + 500]
                finer, probe, owners = entries(fps, radius, 2)
                keys = mix(key[i : i + 500][owners] + finer * np.uint64(_ODD))
                columns = [pa.array(keys.view(np.int64)), pa.array(fps[owners].view(np.int64)), pa.array(probe)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "fp", "probe"])

    schema = "key long, fp long, probe boolean"
    probes = prints.mapInArrow(explode, schema)
    if n > ENTRY_ROWS:  # an entry has a fingerprint once at most
        hot = probes.groupBy("key").count().filter(F.col("count") > ENTRY_ROWS).select("key")  # one key for so many rows
        finer = probes.join(F.broadcast(hot), "key", "left_semi").mapInArrow(deal_on, schema)
        probes = probes.join(F.broadcast(hot), "key", "left_anti").unionByName(finer)
    return probes.repartition("key").sortWithinPartitions("key").mapInArrow(search, "a long, b long").distinct()


def near_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest doc_id that links reach, for each row of ``docs`` (doc_id, text)."""
    prints = cut(fingerprints(docs.select("doc_id", "text"), words, seed), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    reached = components(links(nodes.select("fp"), radius))
    classes = nodes.join(reached, nodes["fp"] == reached["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("class")
    )
    classes = cut(classes, "classes")
    named = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    by_print = classes.join(named, "class").select(F.col("fp").alias("own"), "component_id")
    return prints.join(by_print, prints["fp"] == by_print["own"], "left").select("doc_id", "fp", "component_id")


def _dense(f1: np.ndarray, radius: int, most: int) -> bool:
    """Whether most rows of a large entry have far more than ``most`` others within ``radius`` (a look at 64 of them)."""
    some = f1[:: max(1, len(f1) // 64)]
    near = (_popcount(some[:, None] ^ f1[None, :]) <= radius).sum(axis=1)
    return bool(np.median(near) > 16 * most)


def _nearest(keys, probes, nodes, f1, f2, radius: int, total: int, most: int):
    """For each stored row its ``most`` nearest others in its entry: (node, other, distance, whether more lie as near).

    Rows come sorted by key. Near means ``radius`` bits of the first fingerprint (``LOOSE`` more than the tables are sure to find) and
    ``total`` bits of both. Where more lie as near, links
    of distance ``LINK`` join what chains of near rows join. An entry where very many lie near one another is searched in pieces
    of alike rows; all its rows have more then, and such links lead from each to its piece's first row and on to the next piece.
    """
    found = [(nodes[:0], nodes[:0], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool))]

    def add(a, b, d, more):
        found.append((a, b, np.full(len(a), LINK) if d is None else d, np.full(len(a), more) if isinstance(more, bool) else more))

    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.append(starts[1:], len(keys))
    useful = (ends - starts > 1) & (np.add.reduceat((~probes).astype(np.int64), starts) > 0)
    for lo, hi in zip(starts[useful].tolist(), ends[useful].tolist()):
        pieces, dense = [np.arange(lo, hi)], hi - lo > 2 * PIECE and _dense(f1[lo:hi], radius, most)
        if dense:
            order = lo + np.lexsort((f2[lo:hi], f1[lo:hi]))
            pieces = np.array_split(order, -(-len(order) // PIECE))
            heads = nodes[[p[0] for p in pieces]]
            add(heads[:-1], heads[1:], None, True)
            for own, head in zip(pieces, heads):
                add(nodes[own], np.full(len(own), head), None, True)
        for own in pieces:
            stored = own[~probes[own]]
            crowd = np.zeros(len(own), dtype=bool)
            step = max(1, (1 << 18) // len(own))
            for at in range(0, len(stored), step):
                part = stored[at : at + step]
                d = _popcount(f1[part][:, None] ^ f1[own][None, :])
                i, j = np.nonzero(d <= radius)
                both = d[i, j] + _popcount(f2[part[i]] ^ f2[own[j]])
                keep = (both <= total) & (nodes[part[i]] != nodes[own[j]])
                i, j, both = i[keep], j[keep], both[keep].astype(np.int64)
                if not len(i):
                    continue
                order = np.lexsort((mix((nodes[own[j]] ^ nodes[part[i]]).view(np.uint64)), both, i))
                i, j, both = i[order], j[order], both[order]
                first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                size = np.diff(np.append(first, len(i)))
                rank = np.arange(len(i)) - np.repeat(first, size)
                more = np.repeat(size > most, size)
                crowd[j[more]] = True
                crowd |= np.isin(own, part[i[more]])
                keep = rank < most
                add(nodes[part[i]][keep], nodes[own[j]][keep], both[keep], more[keep] | dense)
            if crowd.any() and not dense:
                rows = own[crowd]
                a, b = reach(f1[rows], ~probes[rows], radius, f2[rows], total)
                add(nodes[rows[b]], nodes[rows[a]], None, False)  # each row found leads back: no row has many
    return tuple(np.concatenate(x) for x in zip(*found))


def candidates_of(nodes: DataFrame, radius: int, total: int, most: int, apart: bool = False) -> DataFrame:
    """``a, b, d, rank, more``: each of ``nodes`` (node, fp, fp2) with others within the bits, at distance ``d``, ranked.

    Every two within ``radius`` bits of the first fingerprint and ``total`` of both meet in a table, and most of those within ``LOOSE``
    more.
    ``more`` is true of all rows of a node that has more than ``most`` others so near; rows with a ``d`` of ``LINK`` then lead, by
    chains, to all of them. ``apart``: the tables are dealt out and searched one after the other, so that the rows of one are on disk at a time.
    """
    count = choose_segments(nodes.count(), radius)

    def explode(only):
        def run(batches):
            for batch in batches:
                columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                for i in range(0, batch.num_rows, 2000):
                    node, fp, fp2 = (x[i : i + 2000] for x in columns)
                    keys, probes, at = entries(fp.view(np.uint64), radius, count, only)
                    found = [keys.view(np.int64), probes, node[at], fp[at], fp2[at]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["key", "probe", "node", "fp", "fp2"])

        return run

    def search(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def found(last):
            nonlocal held, size
            columns = [np.concatenate(x) for x in zip(*held)]
            key, whole = columns[0], len(columns[0])
            stop = whole if last else int(np.searchsorted(key, key[-1]))
            left = stop
            if not stop and whole >= ENTRY_ROWS:  # one entry beyond what is held at once: its last row leads on to the rest
                stop, left = whole, whole - 1
            own = (x[:stop].view(np.uint64) for x in columns[3:])
            out = _nearest(key[:stop], columns[1][:stop], columns[2][:stop], *own, radius + LOOSE, total, most)
            held = [tuple(x[left:] for x in columns)]
            size = 0
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            if left < stop:
                row = columns[2][:stop]
                extra = (row, np.full(stop, row[-1]), np.full(stop, LINK), np.ones(stop, dtype=bool))
                out = tuple(np.concatenate(x) for x in zip(out, extra))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["a", "b", "d", "more"])

        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)))
            size += batch.num_rows
            if size >= ENTRY_ROWS // 4:
                yield found(False)
        if held:
            yield found(True)

    def searched(only=None):
        rows = nodes.select("node", "fp", "fp2").mapInArrow(explode(only), "key long, probe boolean, node long, fp long, fp2 long")
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(search, "a long, b long, d long, more boolean")

    found = _union([cut(searched(s), "table") for s in range(len(segments(radius, count)))]) if apart else searched()
    pairs = found.groupBy("a", "b").agg(F.min("d").alias("d"), F.max("more").alias("more"))
    own = Window.partitionBy("a")  # some rows for each table at most
    ranked = pairs.filter("a <> b").withColumn("rank", F.row_number().over(own.orderBy("d", F.xxhash64("a", "b"))))
    near = F.sum((F.col("d") < LINK).cast("int")).over(own)
    return ranked.withColumn("more", F.max("more").over(own) | (near > most))


def _compare_blocks(similarity: float):
    """Links (a, b) between alike nodes of different classes in each task (rows task, node, class, shingles; sorted by task)."""

    def links_of(rows):
        rows = list({r[1]: r for r in rows}.values())
        sets = [np.array(r[3], dtype=np.int64) for r in rows]
        # Sets as alike as that differ in this share of bits on average; four standard deviations are let through.
        share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
        bits = 64 * SKETCH
        limit = share * bits + 4 * np.sqrt(bits * share * (1 - share))
        sketches = np.stack([sketch(x.view(np.uint64), SKETCH) for x in sets])
        _, root = np.unique(np.array([r[2] for r in rows], dtype=np.int64), return_inverse=True)
        out = []
        for i in range(len(rows) - 1):
            others = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
            d = _popcount(sketches[others] ^ sketches[i]).sum(axis=1, dtype=np.int64)
            near = np.flatnonzero(d <= limit)
            for j in others[near[np.argsort(d[near], kind="stable")]].tolist():
                if root[i] == root[j]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                    out.append((rows[i][1], rows[j][1]))
                    root[root == root[j]] = root[i]
        return out

    def run(batches):
        held = []

        def emit():
            links_ = links_of(held)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links_], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for part in slices([batch], 256):
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    if held and held[0][0] != row[0]:
                        yield emit()
                        held = []
                    held.append(row)
        if held:
            yield emit()

    return run


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def links_between(
    open_: DataFrame, sets: DataFrame | list[DataFrame], similarity: float, block: int | None = None, most: int | None = None
) -> DataFrame:
    """``a, b``: links that join every two classes of ``open_`` (node, span, class) with alike nodes in the same span.

    Nodes are dealt to blocks of about ``block``: large classes to their own, small ones together. Every two blocks of a span
    meet in a task, unless both are of one class; what is compared there stays there, but for fewer links than nodes.
    Tasks whose sets are more than ``most`` bytes together are dealt to rounds of about that, one after the other: the sets sent grow as
    the square of a span's nodes. A list of ``sets`` holds parts made by ``cut``: each is read once, and removed then.
    """
    block = block or BLOCK
    sizes = open_.groupBy("span", "class").agg(F.count("*").alias("size"))
    small = sizes.filter(F.col("size") < block).groupBy("span").agg(F.sum("size").alias("rest"))
    several = sizes.groupBy("span").agg(F.count("*").alias("classes")).filter("classes > 1").select("span")
    dealt = open_.join(sizes, ["span", "class"]).join(several, "span").join(small, "span", "left")
    large = F.col("size") >= block
    parts = F.ceil(F.when(large, F.col("size")).otherwise(F.col("rest")) / block)
    owner = F.when(large, F.col("class"))
    dealt = dealt.withColumns({"owner": owner, "part": F.pmod(F.xxhash64(F.when(large, F.col("node")).otherwise(F.col("class"))), parts)})
    dealt = dealt.withColumn("block", F.xxhash64("span", F.coalesce(owner.cast("string"), F.lit("small")), "part"))
    dealt = cut(dealt.select("node", "class", "span", "owner", "block"), "dealt")
    blocks = dealt.select("span", "owner", "block").distinct()  # one row for some ``block`` nodes
    others = blocks.select("span", F.col("owner").alias("owner2"), F.col("block").alias("block2"))
    tasks = blocks.join(others, "span").filter("block <= block2 and not coalesce(owner = owner2, false)")
    tasks = tasks.select(F.xxhash64("block", "block2").alias("task"), F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))

    def compared(rows):
        rows = rows.select("task", "node", "class", "shingles").repartition("task").sortWithinPartitions("task")
        return rows.mapInArrow(_compare_blocks(similarity), "a long, b long")

    own = dealt.select("node", "class", "block")
    if isinstance(sets, DataFrame):
        return compared(own.join(tasks, "block").join(sets, F.col("node") == F.col("text_hash")))
    parts = []
    for part in sets:
        parts.append(cut(own.join(part, F.col("node") == F.col("text_hash")).select("node", "class", "block", "shingles"), "blocks"))
        drop_cut(part)
    held = _union(parts)
    tasks = cut(tasks, "tasks")
    weights = held.groupBy("block").agg(F.sum(F.size("shingles").cast("long") * 8 + 64).alias("bytes"))
    sent = tasks.join(weights, "block").agg(F.sum("bytes")).first()[0] or 0
    rounds = max(1, -(-sent // (most or PART_BYTES)))
    found = []
    for i in range(rounds):
        now = tasks.filter(F.pmod(F.xxhash64("task", F.lit("round")), F.lit(rounds)) == i)
        found.append(cut(compared(held.join(F.broadcast(now) if rounds > 1 else now, "block")), "fresh"))
    for part in parts:
        drop_cut(part)
    return _union(found)


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float, others: DataFrame | None = None) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets in ``sets`` (text_hash, shingles) have a Jaccard similarity of ``similarity`` or more; ``others`` has those of b, if given."""
    others = sets if others is None else others
    both = pairs.join(sets.select(F.col("text_hash").alias("a"), F.col("shingles").alias("sa")), "a")
    both = both.join(others.select(F.col("text_hash").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    alike = (F.size("sa") == 0) & (F.size("sb") == 0) | (shared >= similarity * (F.size("sa") + F.size("sb") - shared))
    return both.filter(alike).select("a", "b")


def _text_hashes(text: Column) -> tuple[Column, Column]:
    """Two hashes of 64 bits, from different seeds."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(SEED), text)


def text_keys(docs: DataFrame) -> Callable[[DataFrame, str, str], DataFrame]:
    """A function of (rows, text column, name) that adds a long column which tells the texts of ``docs`` apart by 128 bits.

    It is the first hash; where different texts share one (some 3 of 10**10), those whose second hash isn't the least there
    take a hash of both.
    """
    own, other = _text_hashes(F.col("text"))
    shared = docs.select(own.alias("_own"), other.alias("_other")).groupBy("_own").agg(F.min("_other").alias("_first"), F.max("_other").alias("_last"))
    shared = cut(shared.filter("_first <> _last").drop("_last"), "shared-hashes")
    if shared.isEmpty():
        return lambda rows, text, name: rows.withColumn(name, _text_hashes(F.col(text))[0])

    def add(rows: DataFrame, text: str, name: str) -> DataFrame:
        own, other = _text_hashes(F.col(text))
        found = rows.join(shared, own == F.col("_own"), "left")
        first = F.col("_first").isNull() | (other == F.col("_first"))
        return found.withColumn(name, F.when(first, own).otherwise(F.xxhash64(own, other))).drop("_own", "_first")

    return add


def similar_groups(docs: DataFrame, words: int = 5, radius: int = 11, similarity: float = 0.8, keys=None) -> DataFrame:
    """``doc_id, text_hash, keeper``: groups of texts whose shingle sets have a Jaccard similarity of ``similarity`` or more.

    Two fingerprints of each distinct text's shingle set (a line that a text repeats counts once): the tables hold the first;
    candidates are texts that meet in a table and lie within ``radius`` + ``LOOSE`` bits of it and ``TOTAL`` bits of both. Sets at a
    similarity of 0.8 differ in 10 and 19 bits on average, and one of the first fingerprint's six segments or more differs in one bit at most
    for 98 of 100 such pairs. Each text takes its ``NEAREST`` nearest candidates, whose sets are compared. Where texts have more
    candidates than that and fall into several groups, what is left is compared in blocks (``links_between``), so that no two
    candidates go unjoined and no pairs of a large group are ever written.
    A group is what these links join; ``keeper`` is its smallest doc_id. ``text_hash`` tells texts apart (``text_keys``, of ``docs``
    where not given).

    Beyond ``PART_BYTES`` of text the shingle sets are written in parts by the texts' hashes, pairs are compared for every two parts and the tables
    searched one after the other; the shuffle files of each step go before the next. Its disk doesn't grow with the number of pairs then.
    """
    keys = keys or text_keys(docs)
    hashed = keys(docs.select("doc_id", "text"), "text", "text_hash").select("doc_id", "text_hash", "text")
    prints = cut(set_fingerprints(hashed, words), "prints")
    nodes = prints.groupBy(F.col("text_hash").alias("node")).agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.min("fp2").alias("fp2"))
    nodes = cut(nodes, "nodes")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, min(PARTS, -(-size // PART_BYTES)))
    part_of = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit("part")), F.lit(parts))
    found = cut(candidates_of(nodes, radius, TOTAL, NEAREST, parts > 1), "candidates")
    candidates = found.filter((F.col("d") < LINK) & (F.col("rank") <= NEAREST))
    candidates = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    cramped = found.filter("more")
    wanted = candidates.select("a").union(candidates.select("b")).union(cramped.select("a")).distinct()
    if parts > 1:
        candidates, wanted = cut(candidates, "pairs"), cut(wanted, "wanted")
    texts = keys(docs.select("text"), "text", "text_hash").select("text_hash", "text")

    def some(i):
        own, ids = (texts.filter(part_of("text_hash") == i), wanted.filter(part_of("a") == i)) if parts > 1 else (texts, wanted)
        return own.join(ids, F.col("text_hash") == F.col("a"), "left_semi").dropDuplicates(["text_hash"])

    def sets(batches):
        for batch in slices(batches):
            own = [distinct(shingle_hashes(t, words)).view(np.int64) for t in column_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], ["text_hash", "shingles"])

    # Written, so that both sides of the next joins are plain exchanges, which Spark splits where one text has many links.
    own = [cut(some(i).mapInArrow(sets, "text_hash long, shingles array<long>"), "shingles") for i in range(parts)]
    swap = part_of("a") > part_of("b")
    ordered = candidates.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    checked = []
    for i, j in combinations_with_replacement(range(parts), 2):
        pairs = ordered.filter((part_of("a") == i) & (part_of("b") == j)) if parts > 1 else candidates
        checked.append(cut(_alike(pairs, own[i], similarity, own[j]), "alike"))
    checked = _union(checked)
    reached = cut(components(checked), "reached")
    if not cramped.isEmpty():
        # Spans: what chains of near texts join, over the groups found so far.
        label = reached.select(F.col("node").alias("of"), "component")
        ends = cramped.select("a", "b").join(label, F.col("a") == F.col("of"), "left").select(F.coalesce("component", "a").alias("x"), "b")
        ends = ends.join(label, F.col("b") == F.col("of"), "left").select("x", F.coalesce("component", "b").alias("y"))
        steps = ends.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        spans = cut(components(steps), "spans")
        open_ = cramped.select(F.col("a").alias("node")).distinct().join(reached, "node", "left")
        open_ = open_.select("node", F.coalesce("component", "node").alias("class"))
        open_ = open_.join(spans.select(F.col("node").alias("class"), F.col("component").alias("span")), "class").select("node", "span", "class")
        fresh, own = links_between(cut(open_, "open"), own, similarity, most=max(PART_BYTES, size // PARTS)), []
        if not fresh.isEmpty():
            reached = cut(components(checked.unionByName(fresh)), "reached")
    for part in own:
        drop_cut(part)
    classes = nodes.join(reached, "node", "left").select("node", "least", F.coalesce("component", "node").alias("class"))
    keepers = classes.groupBy("class").agg(F.min("least").alias("keeper"))
    named = classes.join(keepers, "class").select("node", "keeper")
    return prints.join(named, F.col("text_hash") == F.col("node")).select("doc_id", "text_hash", "keeper")


def drop_similar(docs: DataFrame, words: int = 5, radius: int = 11, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group left, the one with the smallest doc_id; columns as they are.

    Of rows that repeat the keeper's id and text one stays. In a group without ids one row for each distinct text stays.
    """
    keys = text_keys(docs)
    groups = cut(similar_groups(docs, words, radius, similarity, keys), "groups")
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("keeper"))).select(F.col("doc_id").alias("k_id"), "text_hash").distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    doc, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    rows = keys(rows, text, "h")
    left = rows.join(kept, (rows["h"] == kept["text_hash"]) & F.col(doc).eqNullSafe(kept["k_id"]), "left_semi")
    again = groups.groupBy("doc_id", "text_hash").count().filter("count > 1")
    if again.isEmpty():
        return left.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
    left = left.dropDuplicates(["h", doc])
    return left.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: classes of all documents at four words and four bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
