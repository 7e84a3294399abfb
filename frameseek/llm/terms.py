"""Words of ASCII letters, digits and everything beyond ASCII, A-Z lower-cased and nothing else, as UTF-8 bytes.

The characters between words are those of ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing.
"""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
NOT_WORD = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A byte, lower-cased if it is an ASCII letter.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(data: bytes) -> list[bytes]:
    return WORD.findall(data.lower())


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer of bytes."""
    inside = np.concatenate(([False], IS_WORD[buf], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]
