"""The tokens of ``functions.text`` for a text in hand, where a task counts them instead of making a row of each."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameseek.functions import text as tx

WORD = re.compile(r"\w+")
PUNCTUATION = re.compile(r"[^\w \t\n\x0b\f\r]+")
MARKS = re.compile("[\u0300-\uffff]")
FOLD = str.maketrans(tx._MARKED, tx._BARE)


def fold_full(text: str) -> str:
    low = text.strip(" ").lower()
    if low.isascii():
        return low
    low = low.translate(FOLD)
    if MARKS.search(low):
        low = "".join(c for c in low if unicodedata.category(c) != "Mn")
    return low.replace("đ", "d")


def words_and_bigrams(text: str) -> list[str]:
    """Words, then the bigrams a_b within each stretch without punctuation."""
    words, pairs = [], []
    for phrase in PUNCTUATION.split(text.lower()):
        some = WORD.findall(phrase)
        words += some
        pairs += [f"{a}_{b}" for a, b in zip(some, some[1:])]
    return words + pairs


def char_ngrams(text: str, n: int = 3) -> list[str]:
    return [w[i : i + n] for w in (f"_{x}_" for x in WORD.findall(fold_full(text))) for i in range(max(len(w) - n + 1, 1))]


@dataclass(frozen=True)
class Tokeniser:
    """One rule in two forms: of a column, and of a text."""

    column: Callable[[Column], Column]
    text: Callable[[str], list[str]]


EXACT = Tokeniser(tx.tokens, words_and_bigrams)
FOLDED = Tokeniser(lambda c: tx.tokens(tx.fold_full(c)), lambda t: words_and_bigrams(fold_full(t)))
CHARS = Tokeniser(lambda c: tx.char_ngrams(c), char_ngrams)
