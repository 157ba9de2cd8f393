"""Suffix arrays by induced sorting, and permuted common prefixes, on NumPy arrays.

Suffixes are classified as S (smaller than the next one) or L. An S suffix after an L suffix is leftmost-smaller (LMS). The
LMS substrings are sorted by a first induction and named; where names repeat, the string of names is sorted by
recursion, naming pairs of names until all differ. From the sorted LMS suffixes a second induction places all others, L
types in a scan from the left and S types in one from the right. Both scans go bucket by bucket (a byte value each), and
within a bucket in rounds, so that every suffix is handled once and in array operations.

Common prefixes are computed in text order: where the bytes before a suffix and before its predecessor in the array
agree, its prefix is one shorter than that of the suffix before it in the text; only the others are compared.

An empty text has an empty array; texts of one repeated byte, and any bytes, zero among them, are texts like others.
"""

from __future__ import annotations

import numpy as np


def smaller_types(text: np.ndarray) -> np.ndarray:
    """True for S types; the end of the text is smaller than any byte, so the last suffix is L."""
    n = len(text)
    out = np.zeros(n, dtype=bool)
    if n < 2:
        return out
    # Each position takes the type of the next one that differs from its successor; the last run is L.
    at = np.where(text[:-1] != text[1:], np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    out[:-1] = (at < n - 1) & (text[at] < text[np.minimum(at + 1, n - 1)])
    return out


def _deal(queues: list[list[np.ndarray]], items: np.ndarray, keys: np.ndarray) -> None:
    """Appends ``items`` to the queues of their keys, in order."""
    if not len(items):
        return
    order = np.argsort(keys, kind="stable")
    keys, items = keys[order], items[order]
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    for part, first in zip(np.split(items, cuts), [0, *cuts.tolist()]):
        queues[keys[first]].append(part)


def _drain(queues: list[list[np.ndarray]], c: int, text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Scans bucket ``c``: every entry induces the suffix before it where ``wanted``; in the order of the scan."""
    seen = []
    front = np.concatenate(queues[c]) if queues[c] else np.zeros(0, dtype=np.int32)
    while len(front):
        seen.append(front)
        before = front[front > 0] - 1
        before = before[wanted[before]]
        keys = text[before]
        same = keys == c
        if same.all():
            front = before
            continue
        _deal(queues, before[~same], keys[~same])
        front = before[same]
    return np.concatenate(seen) if seen else np.zeros(0, dtype=np.int32)


def induce(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that follows from the order of ``lms`` (sorted suffixes, or any order to sort LMS substrings)."""
    is_l = ~is_s
    l_queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    stored: list[list[np.ndarray]] = [[] for _ in range(256)]
    _deal(stored, lms, text[lms])
    l_queues[text[-1]].append(np.array([len(text) - 1], dtype=np.int32))  # what the end induces
    l_parts = []
    for c in range(256):
        l_parts.append(_drain(l_queues, c, text, is_l))
        l_queues[c] = []
        for part in stored[c]:
            before = part[part > 0] - 1
            before = before[is_l[before]]
            _deal(l_queues, before, text[before])
    s_queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    s_parts: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * 256
    for c in range(255, -1, -1):
        s_parts[c] = _drain(s_queues, c, text, is_s)[::-1]
        s_queues[c] = []
        back = l_parts[c][::-1]
        before = back[back > 0] - 1
        before = before[is_s[before]]
        _deal(s_queues, before, text[before])
    return np.concatenate([x for pair in zip(l_parts, s_parts) for x in pair])


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position, as an overlapping uint64 view of a zero-padded copy."""
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((len(text) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))


def _name(text: np.ndarray, lms: np.ndarray, in_order: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings, in text order; equal substrings get equal names, smaller ones smaller names."""
    n = len(text)
    ends = np.append(lms[1:], n)
    at = np.searchsorted(lms, in_order)
    sizes = (ends - lms + 1)[at]  # the next LMS suffix's byte belongs to the substring
    a, b = in_order[:-1].astype(np.int64), in_order[1:].astype(np.int64)
    equal = (sizes[:-1] == sizes[1:]) & (ends[at][:-1] < n) & (ends[at][1:] < n)
    words, open_, done = words_at(text), np.flatnonzero(equal), 0
    while len(open_):
        left = sizes[open_] - done
        mask = np.where(left >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1))
        same = ((words[a[open_] + done] ^ words[b[open_] + done]) & mask) == 0
        equal[open_[~same]] = False
        done += 8
        open_ = open_[same & (sizes[open_] > done)]
    ranks = np.concatenate([[0], np.cumsum(~equal)])
    names = np.empty(len(lms), dtype=np.int64)
    names[at] = ranks
    return names


def _sort_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the string of names: names of pairs, then of pairs of those, until all differ.

    A rank is the place of the first suffix that can't be told from it yet; only those that share one are sorted again.
    """
    n, step = len(names), 1
    counts = np.bincount(names)
    rank = (np.cumsum(counts) - counts)[names]
    open_ = np.flatnonzero(counts[names] > 1)
    while len(open_):
        after = open_ + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[open_] * (n + 1) + second
        order = np.argsort(key)
        open_, key = open_[order], key[order]
        old = rank[open_]
        at = np.arange(len(open_))
        starts = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.maximum.accumulate(np.where(starts, at, 0))
        base = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
        rank[open_] = old + group - base
        single = starts & np.concatenate([starts[1:], [True]])
        open_ = open_[~single]
        step *= 2
    out = np.empty(n, dtype=np.int64)
    out[rank] = np.arange(n)
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of the bytes in ``text``, in order."""
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int32)
    is_s = smaller_types(text)
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        marked = np.zeros(n, dtype=bool)
        marked[lms] = True
        first = induce(text, is_s, lms)
        in_order = first[marked[first]]
        names = _name(text, lms, in_order)
        distinct = int(names.max()) + 1
        lms = in_order if distinct == len(lms) else lms[_sort_names(names)]
    return induce(text, is_s, lms)


def permuted_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each position, the bytes its suffix shares with its predecessor in the suffix array (0 for the first)."""
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    before = np.empty(n, dtype=np.int64)
    before[array[0]] = -1
    before[array[1:]] = array[:-1]
    at = np.arange(n)
    bounded = before >= 0
    follows = bounded & (at > 0) & (before > 0)
    follows[1:] &= text[np.maximum(before[1:], 1) - 1] == text[:-1]
    first = np.flatnonzero(~follows)
    length = np.zeros(n, dtype=np.int64)
    words, open_ = words_at(text), first[bounded[first]]
    while len(open_):
        i, j = open_ + length[open_], before[open_] + length[open_]
        gap = words[np.minimum(i, n)] ^ words[np.minimum(j, n)]
        room = n - np.maximum(i, j)  # no byte beyond the end counts
        low = gap & (~gap + np.uint64(1))
        same = np.where(gap == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        same = np.minimum(same, np.maximum(room, 0))
        length[open_] += same
        open_ = open_[(same == 8) & (room > 8)]
    since = first[np.searchsorted(first, at, "right") - 1]
    return np.where(follows, np.maximum(length[since] - (at - since), 0), length)
