"""The permuted congruential generator PCG-XSH-RR (64-bit state, 32-bit output), as published by its author.

Draws happen on the driver, a few for each cluster centre, so plain integers do.
"""

from __future__ import annotations

# The generator's published multiplier, and the word sizes of the draws that results must equal.
MULTIPLIER = 6364136223846793005
WORD = 1 << 64
HALF_WORD = 1 << 32
DOUBLE_BITS = 53


class Pcg32:
    """A stream chosen by the seed, which is also its starting point; the state moves on once before and after the seed."""

    def __init__(self, seed: int):
        seed %= WORD
        self._step = (2 * seed + 1) % WORD
        self._state = self._step
        self._state = self._moved((self._state + seed) % WORD)

    def _moved(self, state: int) -> int:
        return (state * MULTIPLIER + self._step) % WORD

    def word32(self) -> int:
        state, self._state = self._state, self._moved(self._state)
        folded = (state ^ state >> 18) >> 27 & HALF_WORD - 1
        turn = state >> 59
        return (folded >> turn | folded << 32 - turn) & HALF_WORD - 1

    def word64(self) -> int:
        high = self.word32()
        return high * HALF_WORD + self.word32()

    def uniform(self) -> float:
        """In [0, 1), from the upper 53 bits."""
        return (self.word64() >> 64 - DOUBLE_BITS) / (1 << DOUBLE_BITS)

    def below(self, n: int) -> int:
        """An integer in [0, n); words past the last whole multiple of ``n`` below the largest word are drawn anew."""
        last = (WORD - 1) // n * n
        word = self.word64()
        while word >= last:
            word = self.word64()
        return word % n
