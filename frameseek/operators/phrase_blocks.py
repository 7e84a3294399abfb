"""Texts as packed blocks of word numbers, and the phrases that two sets of such texts share.

A block holds each distinct word once and a number a position, so it is smaller than its texts. Of
its phrases only hash values of 40 bits leave it, sorted, as differences, about three bytes a distinct
phrase; they meet those of the other side by ranges, and each block is told which of its own the
other side has too. Only those are made into strings. A hash value decides no match: equal ones of
different phrases only make a few strings more, which the join of the strings then leaves out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, IntegerType, StringType, StructField, StructType

from frameseek.operators.staging import written

#: Bytes of words in a block; a text is not cut.
BLOCK_CHARS = 4_000_000
#: Bits of a phrase's hash value, and the bytes that hold them.
BITS, BYTES = 40, 5


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A hash value a word: its bytes, each times a number that its place gives, summed."""
    lengths = np.asarray(pc.binary_length(words), dtype=np.int64)
    ends = np.cumsum(lengths)
    data = np.frombuffer("".join(words.to_pylist()).encode(), np.uint8)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(ends - lengths, lengths)
    value = (data.astype(np.uint64) + np.uint64(1)) * _mixed((place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    return _mixed(before[ends] - before[ends - lengths])


class Block:
    """Texts of one block: ``own`` and ``folded`` words, ``fold`` from the one to the other, ``codes`` a position."""

    def __init__(self, blob: bytes) -> None:
        row = pa.ipc.open_stream(blob).read_next_batch()
        self.ids, sizes, codes, self.own, fold, self.folded, marked = (c.values for c in row.columns)
        self.codes, self.fold = codes.to_numpy(), fold.to_numpy()
        sizes = sizes.to_numpy().astype(np.int64)
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes)
        self.at = np.arange(len(self.codes)) - (ends - sizes)[self.text]
        self.left = ends[self.text] - np.arange(len(self.codes))
        self.marked = np.concatenate([[0], np.cumsum(marked.to_numpy(zero_copy_only=False)[self.codes])])

    def phrases(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Words of a phrase, positions where a marked one of so many begins, its hash values."""
        words = _word_hashes(self.folded)[self.fold][self.codes]
        so_far = words
        for n in range(1, min(most, len(words)) + 1):
            if n > 1:
                so_far = so_far[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[n - 1 :]
            many = len(so_far)
            spots = np.flatnonzero((self.left[:many] >= n) & (self.marked[n:] > self.marked[:many]))
            yield n, spots, _mixed(so_far[spots] + np.uint64(n)) >> np.uint64(64 - BITS)

    def strings(self, spots: np.ndarray, n: int, folded: bool) -> pa.Array:
        numbers = [self.codes[spots + k] for k in range(n)]
        return pc.binary_join_element_wise(*(self.folded.take(pa.array(self.fold[x])) if folded else self.own.take(pa.array(x)) for x in numbers), " ")

    def firsts(self, spots: np.ndarray, n: int, rank: np.ndarray | None) -> np.ndarray:
        """Of equal phrases the spot that is first by its text's rank and its place; without ranks, one a text."""
        same = self.text[spots] if rank is None else np.zeros(len(spots), np.int64)
        order = np.lexsort((self.at[spots], same if rank is None else rank[self.text[spots]]))
        spots, same = spots[order], same[order]
        for k in range(n):
            # Words by their numbers: exact, whatever the hash values are.
            same = np.unique(same * len(self.folded) + self.fold[self.codes[spots + k]], return_inverse=True)[1]
        return spots[np.unique(same, return_index=True)[1]]


def _packed(rows: list[pa.RecordBatch]) -> bytes:
    ids = pa.chunked_array([b.column(0) for b in rows]).combine_chunks()
    split = lambda i: pa.chunked_array([pc.split_pattern(b.column(i), " ") for b in rows]).combine_chunks()
    own = split(1)
    words, sizes = own.flatten(), pc.list_value_length(own)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy()
    distinct = coded.dictionary
    if rows[0].num_columns == 2:
        folded, marked = distinct, pa.array(np.ones(len(distinct), bool))
    else:
        first = pa.array(np.unique(codes, return_index=True)[1])
        folded = split(3).flatten().take(first)
        marked = pc.not_equal(split(2).flatten().take(first), folded)
    fold = folded.dictionary_encode()
    columns = (ids, sizes, pa.array(codes), distinct, fold.indices, fold.dictionary, marked)
    one = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(one, names=[str(i) for i in range(len(one))])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _pack(most_chars: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, chars = TaskContext.get().partitionId() << 32, [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([_packed(held)], pa.binary())], names=["block", "blob"])
        for batch in batches:
            ends = np.cumsum(np.asarray(pc.binary_length(batch.column(1)), dtype=np.int64))
            at, before = 0, 0
            while at < batch.num_rows:
                upto = min(int(np.searchsorted(ends, before + most_chars - chars)) + 1, batch.num_rows)
                held.append(batch.slice(at, upto - at))
                chars += int(ends[upto - 1]) - before
                at, before = upto, int(ends[upto - 1])
                if chars >= most_chars:
                    yield made()
                    number, held, chars = number + 1, [], 0
        if held:
            yield made()

    return task


def blocks(texts: DataFrame) -> DataFrame:
    """(block, blob), written down. ``texts``: id, words joined by a space; with the same in lower case and folded, phrases with a word that differs count, else all."""
    return written(texts.mapInArrow(_pack(BLOCK_CHARS), "block long, blob binary"))


def _coded(values: np.ndarray) -> bytes:
    """Sorted values as differences, all lowest bytes first: those above are nearly all 0."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8)[:, :BYTES].T.tobytes()


def _decoded(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(BYTES, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :BYTES] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether a value is among the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _all_of(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _values(side: int, parts: int, most: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([(i << BITS) // parts for i in range(parts + 1)], np.uint64)
        for batch in batches:
            for block, blob in zip(batch.column(0), batch.column(1)):
                own = _all_of([h for _, _, h in Block(blob.as_buffer()).phrases(most)])
                cut = np.searchsorted(own, bounds)
                some = [i for i in range(parts) if cut[i] < cut[i + 1]]
                columns = (some, [side] * len(some), [block.as_py()] * len(some), [_coded(own[cut[i] : cut[i + 1]]) for i in some])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["part", "side", "block", "phrases"])

    return task


def _met(rows: pa.Table) -> pa.Table:
    """Of the values of one range those that both sides have, a row a block."""
    side, own = rows["side"].to_pylist(), [_decoded(x.as_buffer()) for x in rows["phrases"]]
    asked = _all_of([v for s, v in zip(side, own) if s])
    both = _all_of([v[_among(v, asked)] for s, v in zip(side, own) if not s])
    kept = [v[_among(v, both)] for v in own]
    some = [i for i, v in enumerate(kept) if len(v)]
    return pa.table([rows["side"].take(pa.array(some, pa.int64())), rows["block"].take(pa.array(some, pa.int64())), pa.array([_coded(kept[i]) for i in some], pa.binary())], names=["side", "block", "phrases"])


def shared(known: DataFrame, asked: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides' ``blocks`` with ``phrases``, the hash values of what they share; blocks that share nothing are left out."""
    spark = known.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = [side.mapInArrow(_values(i, parts, most), "part int, side int, block long, phrases binary") for i, side in enumerate((known, asked))]
    found = written(values[0].union(values[1]).groupBy("part").applyInArrow(_met, "side int, block long, phrases binary"))
    told = [found.where(F.col("side") == i).groupBy("block").agg(F.collect_list("phrases").alias("phrases")) for i in (0, 1)]
    return known.join(told[0], "block"), asked.join(told[1], "block")


def _chosen(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[Block, int, np.ndarray]]:
    for batch in batches:
        for blob, phrases in zip(batch.column("blob"), batch.column("phrases")):
            block, told = Block(blob.as_buffer()), _all_of([_decoded(x.as_buffer()) for x in phrases])
            for n, spots, values in block.phrases(most):
                spots = spots[_among(values, told)]
                if len(spots):
                    yield block, n, spots


def first_phrases(side: DataFrame, most: int, kind: DataType, ordered: bool) -> DataFrame:
    """(folded, id, at, accented) of a side of ``shared``: of equal phrases the first of its block, null ids last; if ids have no order, one a text."""
    schema = StructType([StructField("folded", StringType()), StructField("id", kind), StructField("at", IntegerType()), StructField("accented", StringType())])
    names, id_type = schema.names, to_arrow_type(kind)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank = None, None
        for block, n, spots in _chosen(batches, most):
            if ordered and block is not last:
                ids = block.ids.to_pylist()
                places = {x: i for i, x in enumerate([*sorted({x for x in ids if x is not None}), None])}
                last, rank = block, np.array([places[x] for x in ids])
            spots = block.firsts(spots, n, rank)
            ids = block.ids.take(pa.array(block.text[spots])).cast(id_type)
            yield pa.RecordBatch.from_arrays([block.strings(spots, n, True), ids, pa.array(block.at[spots], pa.int32()), block.strings(spots, n, False)], names=names)

    return side.mapInArrow(task, schema)


def all_phrases(side: DataFrame, most: int) -> DataFrame:
    """(qid, a, n, phrase) of a side of ``shared``, whose ids are numbers: every place of a shared phrase."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, n, spots in _chosen(batches, most):
            qid = block.ids.take(pa.array(block.text[spots]))
            yield pa.RecordBatch.from_arrays([qid, pa.array(block.at[spots], pa.int32()), pa.array(np.full(len(spots), n), pa.int32()), block.strings(spots, n, True)], names=["qid", "a", "n", "phrase"])

    return side.mapInArrow(task, "qid long, a int, n int, phrase string")
