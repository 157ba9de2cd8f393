"""Words as 64-bit hashes, straight from UTF-8 bytes.

A word is a run of bytes other than space and 0x09-0x0D; A-Z are lower-cased. Its hash is a polynomial over random
byte values modulo 2**64, taken from prefix sums, then mixed. Two of V words share a hash with a probability of about
V * V / 2**65 (a billion words: 3 in 100 that any two do). Empty texts have no words; long ones are hashed piece by piece, a word longer than
a piece whole.
"""

from __future__ import annotations

import functools

import numpy as np

from tabulon.llm.common import chunks_of

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_PIECE = 1 << 19
_SPACES = b" \t\n\x0b\x0c\r"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit over all others (splitmix64's finish)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    lower = np.arange(256, dtype=np.uint64)
    lower[ord("A") : ord("Z") + 1] += np.uint64(32)
    return mix((lower + np.uint64(1)) * _BASE) | np.uint64(1)


_VALUES = _byte_values()


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_BASE), -1, 1 << 64)
    up, down = np.full(n, _BASE), np.full(n, np.uint64(inverse))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _hash_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``data`` and where each begins."""
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(1 << max(10, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


def _slices(text: bytes) -> list[bytes]:
    """Pieces of a long text, cut before white space (a longer word stays whole)."""
    out, at = [], 0
    while len(text) - at > _PIECE:
        cuts = [text.rfind(s, at + 1, at + _PIECE) for s in (b" ", b"\n")]
        cut = max(cuts)
        if cut < 0:
            found = [x for x in (text.find(bytes([s]), at + _PIECE) for s in _SPACES) if x >= 0]
            cut = min(found, default=len(text))
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, text after text, and bounds: text i has [bounds[i], bounds[i + 1])."""
    hashes, counts = [], np.zeros(len(texts), dtype=np.int64)
    for lo, hi in chunks_of(texts, _PIECE):
        if hi - lo == 1 and len(texts[lo]) > _PIECE:
            for part in _slices(texts[lo]):
                h, _ = _hash_piece(np.frombuffer(part, np.uint8))
                hashes.append(h)
                counts[lo] += len(h)
            continue
        h, starts = _hash_piece(np.frombuffer(b" ".join(texts[lo:hi]) + b" ", np.uint8))
        hashes.append(h)
        ends = np.cumsum([len(t) + 1 for t in texts[lo:hi]])
        counts[lo:hi] = np.diff(np.searchsorted(starts, ends), prepend=0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return (np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)), bounds
