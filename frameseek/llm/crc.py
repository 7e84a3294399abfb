"""CRC-32 of many byte runs at once, and the algebra of its combination.

The CRC of ``a + b`` is ``shift(crc(a), len(b)) ^ crc(b)``, where ``shift`` (what zero bytes
behind ``a`` would do to its CRC) is linear over GF(2): a 32 x 32 bit matrix for each length. A
matrix is kept as four tables of 256 values, one a byte of the CRC, so that it is applied to a
whole array by four lookups; lengths beyond the direct tables go by their binary digits.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np

POLYNOMIAL = 0xEDB88320
#: Lengths with a matrix of their own.
DIRECT = 32


@cache
def byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


def _apply(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    return matrix[0][x & 255] ^ matrix[1][x >> 8 & 255] ^ matrix[2][x >> 16 & 255] ^ matrix[3][x >> 24]


@cache
def _one_byte() -> np.ndarray:
    """The matrix of one zero byte."""
    x = np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], dtype=np.uint32)[:, None]
    return byte_table()[x & 255] ^ x >> 8


@cache
def doubled(k: int) -> np.ndarray:
    """The matrix of 2**k zero bytes: the square of the one before."""
    return _one_byte() if k == 0 else _apply(doubled(k - 1), doubled(k - 1))


@cache
def _direct() -> np.ndarray:
    """Matrices of 0 to DIRECT - 1 zero bytes."""
    same = np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], dtype=np.uint32)[:, None]
    out = [same]
    for _ in range(DIRECT - 1):
        out.append(_apply(_one_byte(), out[-1]))
    return np.stack(out)


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs after ``length`` more zero bytes each."""
    near, m = np.minimum(length, DIRECT - 1), _direct()
    out = m[near, 0, crc & 255] ^ m[near, 1, crc >> 8 & 255] ^ m[near, 2, crc >> 16 & 255] ^ m[near, 3, crc >> 24]
    left, k = np.maximum(length - (DIRECT - 1), 0), 0
    while left.any():
        odd = np.flatnonzero(left & 1)
        out[odd] = _apply(doubled(k), out[odd])
        left, k = left >> 1, k + 1
    return out


def of_runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRCs of ``buf[start:end]``; each byte is read once, all runs side by side, very long runs by themselves."""
    table, length = byte_table(), ends - starts
    crc = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    short = np.flatnonzero(length < 4 * DIRECT)
    short = short[np.argsort(-length[short], kind="stable")]
    at, size, part = starts[short], length[short], crc[short]
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j, side="left"))  # those longer than j
        part[:n] = table[(part[:n] ^ buf[at[:n] + j]) & 255] ^ part[:n] >> 8
    crc[short] = ~part
    for i in np.flatnonzero(length >= 4 * DIRECT):
        crc[i] = zlib.crc32(buf[starts[i] : ends[i]].tobytes())
    return crc


def ngrams(word: np.ndarray, length: np.ndarray, text: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``n`` words: (position of the last word, CRC of the words joined by one space) of every run within one text.

    No run is spelled out: a run of k + 1 words comes from the run of k before its last word.
    """
    space = np.uint32(zlib.crc32(b" "))
    at, crc = np.arange(len(word)), word
    out = [(at, crc)]
    for k in range(1, n):
        keep = (at + 1 < len(word)) & (text[np.minimum(at + 1, len(word) - 1)] == text[at]) if len(word) else np.zeros(0, dtype=bool)
        at, crc = at[keep] + 1, crc[keep]
        spaced = shift(crc, np.ones(len(crc), dtype=np.int64)) ^ space
        crc = shift(spaced, length[at]) ^ word[at]
        out.append((at, crc))
    return out
