"""Benchmark decontamination by Wu-Manber search for many test strings at once, words as letters.

Test strings are the windows of ``size`` consecutive words of the items (an item of fewer words
is one window). Windows of one length make one table: a shift by block of two words says how far
the search may move on when it sees that block, so most words of a clean text are never looked
at; a block that ends a window selects, by the hash of a longer suffix, the windows that end so,
and their front is compared with the text directly. Shorter windows have tables of their own,
so that they don't shorten the moves for the others.

The windows go to the tasks in blocks of at most ``block_words`` words of items, each collected
and broadcast by itself: one scan of the documents a block, and no table beyond that size in
any process. With several blocks what they find is joined by id and a hash of the text.

Defined results: a null text has no words, neither has one without a letter or digit. Items that
are null or have no words are no windows; an item id that occurs several times is one item, with
the windows of all its rows, and a null one is the item ''. Repeated documents are rows each.
Without items every row is clean. Other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameseek.llm.common import prepare, staged
from frameseek.llm.terms import words

#: Words of the items in one block of windows; a table takes about 1 kB a word.
BLOCK_WORDS = 100_000
#: Words of an item that stay together, so that a very long item is dealt into blocks too.
STRETCH = 1000
FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Table:
    """The windows of one length: shifts by block, windows by suffix."""

    def __init__(self, length: int) -> None:
        self.length, self.block = length, min(2, length)
        #: Words of a window's end that select it; what stands before is compared.
        self.suffix = max(self.block, length // 2)
        self.far = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.ends: dict[tuple, dict[tuple, set[str]]] = {}

    def add(self, window: tuple, item: str) -> None:
        for end in range(self.block, self.length + 1):
            block = window[end - self.block : end]
            self.shift[block] = min(self.shift.get(block, self.far), self.length - end)
        cut = self.length - self.suffix
        self.ends.setdefault(window[cut:], {}).setdefault(window[:cut], set()).add(item)

    def search(self, text: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(start, items) of every window that occurs in the text."""
        n, m, far, shift, back = len(text), self.length, self.far, self.shift, self.block - 1
        i = m - 1
        while i < n:
            move = shift.get((text[i - 1], text[i]) if back else (text[i],), far)
            if move:
                i += move
                continue
            start = i + 1 - m
            cut = i + 1 - self.suffix
            items = self.ends.get(tuple(text[cut : i + 1]), {}).get(tuple(text[start:cut]))
            if items:
                yield start, items
            i += 1


def tables(items: Iterable[tuple[str, bytes]], size: int) -> list[Table]:
    made: dict[int, Table] = {}
    for item, text in items:
        w = words(text)
        m = min(size, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            made.setdefault(m, Table(m)).add(tuple(w[i : i + m]), item)
    return list(made.values())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def occurrences(text: list[bytes], searches: list[Table]) -> tuple[list[tuple[int, int]], list[str]]:
    """Merged spans of words inside any occurrence, and the items found, sorted."""
    spans, items = [], set()
    for t in searches:
        for start, found in t.search(text):
            spans.append((start, start + t.length))
            items |= found
    return merged(spans), sorted(items)


def stretches(items: DataFrame, size: int) -> DataFrame:
    """(item, text, n_words): the words of each item in stretches that overlap by ``size`` - 1, so that each window is in one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                for at in range(0, max(len(w) - size, 0) + 1, STRETCH):
                    part = w[at : at + STRETCH + size - 1]
                    if part:
                        rows.append((item, b" ".join(part), len(part)))
            i, t, n = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.string()), pa.array(t, pa.binary()), pa.array(n, pa.int64())], names=["item", "text", "n_words"])

    return items.where("text is not null").mapInArrow(task, "item string, text binary, n_words long")


def _scan(docs: DataFrame, block: list[tuple[str, bytes]], size: int) -> DataFrame:
    """Of ``docs`` all columns but the text, n_words, and the spans and items of one block of items."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = tables(sent.value, size)
        for batch in batches:
            counts, spans, items = [], [], []
            for data in batch.column("text"):
                text = words(data.as_py() or b"")
                where, which = occurrences(text, searches)
                counts.append(len(text))
                spans.append([{"start": a, "end": b} for a, b in where])
                items.append(which)
            keys = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            yield pa.RecordBatch.from_pydict(keys | {"n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, SPANS), "items": pa.array(items, pa.list_(pa.string()))})

    keys = ", ".join(f"{c} {t}" for c, t in docs.dtypes if c != "text")
    return docs.mapInArrow(task, f"{keys}, {FOUND}")


def _joined(first: DataFrame, others: list[DataFrame]) -> DataFrame:
    """The rows of the first block with what the other blocks found in texts of the same id and hash."""
    rest = reduce(DataFrame.unionByName, others)
    # Equal rows were made one in each block: a list is as long as there are blocks.
    rest = rest.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("spans")).alias("more_spans"), F.flatten(F.collect_list("items")).alias("more_items"))
    rest = rest.withColumnsRenamed({"doc_id": "other_id", "key": "other_key"})
    both = first.join(rest, F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("key") == F.col("other_key")), "left")
    both = both.select("doc_id", "n_words", *[F.concat(c, F.coalesce(f"more_{c}", F.array().cast(dict(both.dtypes)[c]))).alias(c) for c in ("spans", "items")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged([(x["start"], x["end"]) for x in row]) for row in batch.column("spans").to_pylist()]
            spans = [[{"start": a, "end": b} for a, b in row] for row in spans]
            items = [sorted(set(row)) for row in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "items"])

    return both.mapInArrow(task, f"doc_id long, {FOUND}")


def find(docs: DataFrame, items: DataFrame, size: int = 10, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, spans (word positions inside a window's occurrence), items (their ids as text, sorted) of every document."""
    prepare(docs.sparkSession)
    asked = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("binary").alias("text"))
    asked = staged(stretches(asked, size), "decontaminate-items")
    blocks = max(1, math.ceil((asked.agg(F.sum("n_words")).first()[0] or 0) / block_words))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    block = lambda b: [(r.item, bytes(r.text)) for r in asked.where(part == b).collect()]  # noqa: E731  about block_words words
    if blocks == 1:
        return _scan(rows, block(0), size)
    keyed = rows.withColumn("key", F.sha2(F.coalesce("text", F.lit(b"")), 256))
    others = [staged(_scan(keyed, block(b), size).where(F.size("items") > 0).dropDuplicates(["doc_id", "key"]), "decontaminate-block") for b in range(1, blocks)]
    return _joined(_scan(keyed, block(0), size), others)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from what ``find`` returns."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
