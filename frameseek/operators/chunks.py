"""Texts packed into chunks under a token budget, each distinct word counted once.

Texts are dealt into blocks. A block's distinct words meet the distinct words of all texts, which are
counted for themselves, and the counts go back to the block: a row a block and word, none a position.
Packing is a fold over a text's counts: a word that would exceed the budget begins the next chunk. Counting words one by one is never less than a
tokenizer makes of the joined chunk, as far as it keeps word ends.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

WORD = re.compile(r"[^ \t\n\x0B\f\r]+")
#: Characters in one block of texts.
BLOCK_CHARS = 4_000_000


def by_length(word: Column) -> Column:
    """A token for every three characters begun."""
    return F.ceil(F.length(word) / 3)


def words_of(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def counted(words: DataFrame, count: Callable[[Column], Column] | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``words`` with ``tokens``; ``count`` sees each distinct word once, as a column or a table of words, and gives 1 at least."""
    distinct = words.select("word").distinct()
    try:
        table = distinct.select("word", F.greatest(count(F.col("word")).cast("long"), F.lit(1)).alias("tokens"))
    except TypeError:
        table = count(distinct)
    return words.join(table, "word")


def starts(counts: list[int], budget: int) -> list[int]:
    """Positions of the words that begin a chunk, by a fold over the counts; a word over the budget is a chunk."""
    at, used = [], budget + 1
    for i, n in enumerate(counts):
        used += n
        if used > budget:
            at.append(i)
            used = n
    return at


def _packed(budget: int, schema: pa.Schema):
    """A block's texts (id, text, block) and its words' counts (home, word, tokens) to chunks."""

    def block(texts: pa.Table, counts: pa.Table) -> pa.Table:
        tokens = dict(zip(counts.column("word").to_pylist(), counts.column("tokens").to_pylist()))
        place, rows = [], []
        for i, text in enumerate(texts.column("text").to_pylist()):
            words = WORD.findall(text)
            own = [tokens[w] for w in words]
            at = starts(own, budget)
            for chunk, (a, z) in enumerate(zip(at, [*at[1:], len(words)])):
                place.append(i)
                rows.append((chunk, z - a, sum(own[a:z]), " ".join(words[a:z])))
        columns = zip(*rows) if rows else ([],) * 4
        return pa.Table.from_arrays([texts.column("id").take(pa.array(place, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, schema.types[1:]))], schema=schema)

    return block


def pack(texts: DataFrame, budget: int = 64, count=by_length, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, chunk (from 0), words, tokens and chunk_text of every text; null and blank texts have no chunk.

    Rows of one id are texts each.
    """
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    blocks = max(1, math.ceil((rows.agg(F.sum(F.length("text"))).first()[0] or 0) / BLOCK_CHARS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))).repartition("block")
    # Texts lie by blocks already, so a block's distinct words are found where it lies.
    words = dealt.select("block", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word")).distinct()
    counts = counted(words, count).select(F.col("block").alias("home"), "word", "tokens")
    kind = rows.schema["id"].dataType
    shape = to_arrow_schema(StructType([StructField("id", kind), StructField("chunk", IntegerType()), StructField("words", IntegerType()), StructField("tokens", LongType()), StructField("chunk_text", StringType())]))
    done = dealt.groupBy("block").cogroup(counts.groupBy("home")).applyInArrow(_packed(budget, shape), f"id {kind.simpleString()}, chunk int, words int, tokens long, chunk_text string")
    return done.withColumnRenamed("id", id_col)
