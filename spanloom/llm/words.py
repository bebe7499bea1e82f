"""Words, lines and word windows of many texts at once, as numpy arrays.

A batch of texts is one byte array with offsets. Word bounds come from byte classes, and every hash of a byte or word run from
prefix sums of two polynomials modulo a prime, so that the work is a fixed number of passes over the bytes whatever the texts hold.
(Modulo a power of two, regular sequences such as Thue and Morse's would collide whatever the base.)
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

P1, P2, P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


_M = np.uint64((1 << 31) - 1)  # a prime; remainders need shifts and sums alone
_SHIFT = np.uint64(31)
_STEP = 1 << 14


def fold(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, or a little above it: below 2**31 + 5, so that products of two fit 64 bits."""
    x = (x & _M) + (x >> _SHIFT)
    return (x & _M) + (x >> _SHIFT)


def base(p: np.uint64, lane: int) -> int:
    """One of a pair of bases for the constant p."""
    return int(mix(np.array([p + np.uint64(lane)], np.uint64))[0]) % (int(_M) - 1000) + 500


#: The powers made so far, one array a base; a longer one takes its place.
_powers: dict[int, np.ndarray] = {}


def powers(b: int, n: int) -> np.ndarray:
    have = _powers.get(b)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate([have, fold(have * np.uint64(pow(b, len(have), int(_M))))])
        _powers[b] = have
    return have[:n]


def prefix(x: np.ndarray, p: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """For each of two bases, prefix sums of x[i] * base**i modulo a prime, with a leading 0. x: bytes, or hashes of 64 bits."""
    out = []
    for lane in (0, 1):
        pw, sums = powers(base(p, lane), len(x)), np.zeros(len(x) + 1, np.uint64)
        for lo in range(0, len(x), _STEP):  # in steps that stay in the cache
            y = x[lo : lo + _STEP].astype(np.uint64)
            if x.dtype == np.uint8:
                y += np.uint64(1)
            else:
                y = fold(y * P3 if lane else y)
            sums[lo + 1 : lo + 1 + len(y)] = fold(y * pw[lo : lo + len(y)])
        out.append(np.cumsum(sums, out=sums))
    return out[0], out[1]


def span_hash(sums: tuple[np.ndarray, np.ndarray], lo: np.ndarray, hi: np.ndarray, p: np.uint64) -> np.ndarray:
    """Hashes of the spans [lo, hi) below `prefix` sums, independent of where a span lies; of 62 bits, and the length."""
    lanes = []
    for lane, s in enumerate(sums):
        back = powers(pow(base(p, lane), -1, int(_M)), len(s))
        h = fold(fold(s[hi] - s[lo]) * back[lo])
        lanes.append(np.where(h >= _M, h - _M, h))
    return mix(((lanes[0] << _SHIFT) | lanes[1]) + (hi - lo).astype(np.uint64) * P1)


class Words:
    """starts, ends: byte bounds of each word; first: index of each text's first word, with the total at the end."""

    def __init__(self, body: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE):
        self.body, self.off = body, off
        word = ~space[body]
        start, end = word.copy(), word.copy()
        start[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        heads = off[:-1][off[:-1] < off[1:]]  # of texts that aren't empty
        tails = off[1:][off[:-1] < off[1:]] - 1
        start[heads], end[tails] = word[heads], word[tails]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, off)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text's index of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, p: np.uint64 = P1) -> np.ndarray:
        return span_hash(prefix(self.body, p), self.starts, self.ends, p)


def windows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and text of every window of k words that lies within one text."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + first[doc], doc


def covered(starts: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n places some span [start, start + length) covers."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + length, -1)
    return np.cumsum(d[:-1]) > 0
