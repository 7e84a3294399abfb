"""Distinct-word tables over a corpus, in bounded blocks.

A scan cuts the documents into blocks of about ``block_chars`` characters (one or
more whole documents each). Per block it keeps

* a document row: ids, flags and the text as a sequence of word codes, where the
  most frequent words have the least codes and the others go by their letters, and
* up to ``parts`` word bundles: the block's distinct words whose hash falls into the
  part, in code order.

Bundles with the same part meet in one group: there each distinct word of the whole
corpus is handled once (`resolve`). Answers return to their block, and the block's
documents are read off by position (`assemble`). What is shuffled is bundles, not
occurrences: a very common word costs one entry per block, so no word is hot.
"""

from __future__ import annotations

import pickle
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The words of a block that are coded by frequency.
HEAD = 4096
BLOCK_SCHEMA = "block long, part int, data binary"
#: Unicode White_Space, which is what the tokenizer's pre-tokenizer splits on.
_UNICODE_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def split_unicode(text: str) -> list[str]:
    """Words between Unicode white space (str.split() would also split at U+001C to U+001F)."""
    if _SEPARATORS.search(text):
        return [w for w in _UNICODE_SPACE.split(text) if w]
    return text.split()


def split_ascii_lower(text: str) -> list[bytes]:
    """UTF-8 words between ASCII white space, A-Z lower-cased and nothing else."""
    return text.encode().lower().split()


def pack(obj: object) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(obj, protocol=5))


def unpack(data: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def pack_codes(codes: np.ndarray) -> tuple:
    """Word codes near their entropy: a byte for size and leading bits, the other bits packed by size."""
    codes = codes.astype(np.int64)
    size = np.frexp(codes.astype(np.float64))[1] - 1  # position of the leading bit
    big = codes >= 128
    head = np.where(big, (size - 7) * 8 + (codes >> np.maximum(size - 3, 0) & 7) + 128, codes).astype(np.uint16)
    tails = {}
    for k in np.unique(size[big]).tolist():
        rest = codes[big & (size == k)] & ((1 << (k - 3)) - 1)
        tails[k] = np.packbits((rest[:, None] >> np.arange(k - 3) & 1).astype(np.uint8)).tobytes()
    return head.astype(np.uint8 if not len(head) or head.max() < 256 else np.uint16), tails


def unpack_codes(packed: tuple) -> np.ndarray:
    head, tails = packed
    codes = head.astype(np.int64)
    big = codes >= 128
    size = np.where(big, (codes - 128) // 8 + 7, 0)
    for k, data in tails.items():
        at = np.flatnonzero(size == k)
        bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=len(at) * (k - 3)).reshape(len(at), k - 3)
        codes[at] = (8 + (codes[at] - 128) % 8 << (k - 3)) + bits @ (1 << np.arange(k - 3))
    return codes


@dataclass
class Block:
    """One block's documents: parallel ids/flags/lens, and the codes of all words in order."""

    ids: list
    flags: np.ndarray
    lens: np.ndarray
    codes: np.ndarray
    part_of_rank: np.ndarray

    def slots(self) -> np.ndarray:
        """slots()[code]: where the word stands when the block's bundles are laid end to end by part."""
        order = np.argsort(self.part_of_rank, kind="stable")
        where = np.empty(len(order), dtype=np.int64)
        where[order] = np.arange(len(order))
        return where


def read_block(data: bytes) -> Block:
    ids, flags, lens, codes, part = unpack(data)
    return Block(ids, flags, lens, unpack_codes(codes), part)


def _emit(block: int, ids, flags, lens, codes, vocab, parts: int, binary: bool) -> pa.RecordBatch:
    codes = np.frombuffer(codes, dtype=np.int64)
    flags, lens = np.array(flags, dtype=bool), np.array(lens, dtype=np.int32)
    words = list(vocab)
    freq = np.bincount(codes, minlength=len(words))
    order = np.argsort(-freq, kind="stable")
    # Rare words go by their letters: neighbours in a bundle then share prefixes.
    order[HEAD:] = sorted(order[HEAD:].tolist(), key=words.__getitem__)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[codes]
    train = np.bincount(codes[np.repeat(flags, lens)], minlength=len(words)).astype(np.uint32)
    words = [words[i] for i in order]
    raw = words if binary else [w.encode() for w in words]
    part_of = np.fromiter(map(zlib.crc32, raw), dtype=np.uint32, count=len(raw)) % np.uint32(parts)
    rows = [(block, -1, pack((ids, flags, lens, pack_codes(codes), part_of)))]
    by_part = np.argsort(part_of, kind="stable")
    cuts = np.flatnonzero(np.diff(part_of[by_part])) + 1
    for members in np.split(by_part, cuts) if len(by_part) else ():
        rows.append((block, int(part_of[members[0]]), pack((b"\n".join([raw[i] for i in members]), train[members]))))
    b, p, d = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(p, pa.int32()), pa.array(d, pa.binary())], names=["block", "part", "data"])


def build_blocks(df: DataFrame, id_col: str, text_col: str, split: Callable[[str], list], parts: int, flag_col: str | None = None, block_chars: int = 32_000_000) -> DataFrame:
    """Blocks of ``df`` as (block, part, data) rows; part -1 is the document row. Null text: no words."""
    binary = split is split_ascii_lower

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, base = 0, TaskContext.get().partitionId() << 32
        ids, flags, lens, codes, vocab, chars = [], [], [], array("q"), defaultdict(count().__next__), 0
        for batch in batches:
            for doc, text, flag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = split(text) if text else []
                ids.append(doc)
                flags.append(bool(flag))
                lens.append(len(words))
                codes.extend(map(vocab.__getitem__, words))  # a new word gets the next number
                chars += len(text) if text else 0
                if chars >= block_chars or len(ids) >= 200_000:
                    yield _emit(base + made, ids, flags, lens, codes, vocab, parts, binary)
                    made += 1
                    ids, flags, lens, codes, vocab, chars = [], [], [], array("q"), defaultdict(count().__next__), 0
        if ids:
            yield _emit(base + made, ids, flags, lens, codes, vocab, parts, binary)

    flag = F.col(flag_col) if flag_col else F.lit(False)
    return df.select(F.col(id_col), F.col(text_col), flag.alias("flag")).mapInArrow(scan, BLOCK_SCHEMA)


def resolve(blocks: DataFrame, handle: Callable[[list[tuple[int, list[bytes], np.ndarray]]], Iterator[tuple[int, int, bytes]]], parts: int) -> DataFrame:
    """Run ``handle`` once per part on all its bundles [(block, words, flagged counts)]; it yields (block, part, data)."""

    def group(tbl: pa.Table) -> pa.Table:
        part = tbl.column("part")[0].as_py()
        bundles = []
        for block, data in zip(tbl.column("block").to_pylist(), tbl.column("data").to_pylist()):
            words, counts = unpack(data)
            bundles.append((block, words.split(b"\n"), counts))
        out = [(b, part if p is None else p, d) for b, p, d in handle(bundles)]
        b, p, d = zip(*out)
        return pa.table({"block": pa.array(b, pa.int64()), "part": pa.array(p, pa.int32()), "data": pa.array(d, pa.binary())})

    return blocks.where("part >= 0").repartition(parts, "part").groupBy("part").applyInArrow(group, BLOCK_SCHEMA)


def assemble(blocks: DataFrame, resolved: DataFrame, finish: Callable[[Block, list[bytes]], pa.Table], schema: str) -> DataFrame:
    """Bring each block's answers, in part order, back to its documents and run ``finish`` on them."""

    def group(docs: pa.Table, answers: pa.Table) -> pa.Table:
        got = sorted(zip(answers.column("part").to_pylist(), answers.column("data").to_pylist()))
        return finish(read_block(docs.column("data")[0].as_py()), [d for _, d in got])

    left, right = blocks.where("part = -1"), resolved.where("part >= 0")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(group, schema)
