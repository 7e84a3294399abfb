"""Vectorised word and shingle hashes over UTF-8 bytes (numpy, no loop over words).

A word is a maximal run of bytes other than space, \\t, \\n, \\v, \\f, \\r. Word
hashes come from one prefix sum of a polynomial in an odd base modulo 2**64, so
equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

import re

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NEXT_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 14)
        inverse = pow(_BASE, -1, 1 << 64)
        for key, base in (("up", _BASE), ("down", inverse)):
            step = np.full(size, np.uint64(base & (2**64 - 1)), dtype=np.uint64)
            step[0] = 1
            _powers[key] = np.multiply.accumulate(step)
    return _powers["up"], _powers["down"]


def _segment_hashes(buf: np.ndarray) -> np.ndarray:
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    up, down = _power_tables(len(buf) + 1)
    prefix = np.empty(len(buf) + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of ``data`` in order; long texts go in segments that end at a space."""
    if len(data) <= _SEGMENT:
        return _segment_hashes(np.frombuffer(data, dtype=np.uint8))
    out, at = [], 0
    while at < len(data):
        end = at + _SEGMENT
        cut = _NEXT_SPACE.search(data, end) if end < len(data) else None
        end = cut.start() if cut else len(data)
        out.append(_segment_hashes(np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)))
        at = end
    return np.concatenate(out)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all runs of ``k`` words; a text of 1 to k-1 words has one shingle, all its words."""
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    size = min(k, n)
    up, _ = _power_tables(64)
    acc = np.full(n - size + 1, np.uint64(size), dtype=np.uint64)
    for j in range(size):
        acc += words[j : n - size + 1 + j] * up[3 * j + 5]
    return mix(acc)
