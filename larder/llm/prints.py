"""Fingerprints of substrings and words, a buffer at a time."""

from __future__ import annotations

import numpy as np

from .common import mix64

_TABLES = np.random.Generator(np.random.PCG64(20240501)).integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
#: Powers are made in steps, and a worker keeps so many at most.
_STEP, _KEPT = 1 << 18, 1 << 22
_SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


class Prints:
    """Fingerprints of substrings of one buffer, two independent 64-bit ones."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, raw: np.ndarray):
        self.raw, self.sums = raw, {}

    @classmethod
    def powers(cls, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(which)
        if have is None or len(have[0]) < n:
            n = -(-n // _STEP) * _STEP
            base = int(_BASES[which])
            up = np.full(n, base, np.uint64)
            up[0] = 1
            down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
            down[0] = 1
            with np.errstate(over="ignore"):
                have = np.multiply.accumulate(up), np.multiply.accumulate(down)
            if n <= _KEPT:  # those of longer buffers are not kept
                cls._powers[which] = have
        return have

    def of(self, start, length, which: int = 0) -> np.ndarray:
        """Names of ``raw[start:start + length]``; start and length may be arrays."""
        n = len(self.raw)
        up, down = self.powers(which, n + 1)
        with np.errstate(over="ignore"):
            if which not in self.sums:
                s = np.zeros(n + 1, np.uint64)
                np.cumsum(_TABLES[which][self.raw] * up[:n], out=s[1:])
                self.sums[which] = s
            s = self.sums[which]
            return mix64((s[start + length] - s[start]) * down[start])


def word_prints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words (lower-cased A-Z) of the texts in order, and the number of words of each text."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    inside = ~_SPACES[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]  # the last byte is a space, so every word ends
    text = np.searchsorted(bounds, start, side="right")
    return Prints(_LOWER[raw]).of(start, end - start), np.bincount(text, minlength=len(texts))
