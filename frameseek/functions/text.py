"""Text functions over columns: accent folding, tokens, bigrams, clean-up. All JVM-side."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
PUNCTUATION = r"[^\p{L}\p{N}_\s]+"


def _accent_table() -> tuple[str, str]:
    """Lower-case letters with marks and their bare letters, by Unicode decomposition."""
    marked, bare = [], []
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if c == c.lower() and base != c and len(base) == 1:
            marked.append(c)
            bare.append(base)
    return "".join(marked), "".join(bare)


_MARKED, _BARE = _accent_table()


def bare(s: str) -> str:
    """``fold_marks`` of a text in hand."""
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))


def fold_marks(c: Column) -> Column:
    """Lower case without diacritics; the stroked d stays."""
    return F.regexp_replace(F.translate(F.lower(c), _MARKED, _BARE), r"\p{Mn}", "")


def fold_full(c: Column) -> Column:
    """Trimmed, lower case, without diacritics, the stroked d as d."""
    return F.translate(fold_marks(F.trim(c)), "đ", "d")


def has_diacritic(c: Column) -> Column:
    """Whether folding changes it; a pattern with all marked letters tries them one after the other at each character."""
    return fold_marks(c) != F.lower(c)


def phrases(c: Column) -> Column:
    """Arrays of words, one for each stretch without punctuation."""
    return F.filter(F.transform(F.split(F.lower(c), PUNCTUATION), lambda p: F.regexp_extract_all(p, F.lit(WORD), F.lit(0))), lambda p: F.size(p) > 0)


def unigrams(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def tokens(c: Column, bigrams: bool = True) -> Column:
    """Words, then the bigrams a_b within each phrase; no bigram crosses punctuation."""
    if not bigrams:
        return unigrams(c)
    pairs = F.flatten(F.transform(phrases(c), lambda p: F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.concat_ws("_", a, b))))
    return F.concat(unigrams(c), pairs)


def char_ngrams(c: Column, n: int = 3) -> Column:
    """Character n-grams of each folded word set in underscores."""
    framed = lambda w: F.concat(F.lit("_"), w, F.lit("_"))
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
    return F.flatten(F.transform(unigrams(fold_full(c)), lambda w: grams(framed(w))))


def strip_links(c: Column) -> Column:
    """URLs, hashtags and mentions become a sentence break."""
    return F.regexp_replace(c, r"https?://\S+|www\.\S+|#[\p{L}\p{N}_]+|@[\p{L}\p{N}_]+", ". ")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two sets as arrays; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def join_texts(*parts: Column) -> Column:
    """Non-blank parts joined with ' . '."""
    return F.concat_ws(" . ", *[F.when(F.trim(p) != "", F.trim(p)) for p in parts])
