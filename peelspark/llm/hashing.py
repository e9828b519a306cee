"""Hashes of words and shingles of one text, in whole-array steps."""

from __future__ import annotations

import numpy as np

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = 0x9E3779B97F4A7C15
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    """``_ODD ** i`` and its inverse modulo 2**64, as far as the longest text met."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(1 << 16, 2 * n)
            for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
                p = np.full(m, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: bytes, between: np.ndarray = _BETWEEN) -> np.ndarray:
    """64-bit hashes of the runs of bytes outside ``between``, in order."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    edge = np.diff(np.concatenate(([True], between[b], [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every ``k`` words in a row; of the whole sequence if it is shorter, of nothing if empty."""
    if not len(words):
        return words
    short = len(words) < k
    w = [words[i : i + 1] for i in range(len(words))] if short else [words[i : len(words) - k + 1 + i] for i in range(k)]
    h = np.full(len(w[0]), len(w), np.uint64)
    for x in w:
        h = h * np.uint64(_ODD) + x
    return mix(h)


def text_shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased, words between ASCII white space."""
    return np.unique(shingles(word_hashes((text or "").encode("utf-8", "surrogatepass").translate(LOWER)), k))
