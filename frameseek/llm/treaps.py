"""Ranked lexical search over inverted treaps.

A scan of the documents makes shards of bounded size, each an inverted index of its documents: for
every term the documents by ascending id with their term counts. That order, with the impact of a
posting as priority, is a treap for each term: a search tree by document, a heap by impact, so the
root of a subtree holds its largest impact (equal impacts go by a hash, which keeps the trees
flat). Impacts follow from corpus statistics, so pointers are built where a shard is searched, for
the terms that are asked.

A query walks the treaps of its terms together. A step has an interval of documents and, for each
term, the root of what its treap holds there. If the roots' impacts sum to less than the
query's k-th best score so far, nothing in the interval can enter and it is dropped; otherwise the
document of the largest impact is scored, and the interval falls apart before and behind it.
Steps of all queries of a block advance side by side in numpy arrays, at most ``STEPS`` entries at
a time. Best scores are kept from shard to shard of a task, so later shards are cut earlier.

Queries go in blocks of at most ``BLOCK_TERMS`` words, each collected and broadcast by itself;
the index is written to the checkpoint folder once and read again for each block.

Scores are 64-bit integers, as documented at ``impacts``.

Defined results: null texts and texts without a letter or digit are not indexed. A document without
id counts in the statistics but is never returned; rows of one id are documents each, so an id
can be returned as often as it occurs. Rows of one item id (null is an id too) are one item with the
terms of all its rows. Items without terms, or whose terms occur nowhere, return nothing. Equal
scores go by ascending id. Other columns are left alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameseek.llm.common import prepare, staged
from frameseek.llm.terms import words

#: Bytes of text in a shard; a longer document is a shard of its own.
SHARD_BYTES = 8_000_000
#: Words of the items that are searched for together.
BLOCK_TERMS = 50_000
#: Entries (a term in a step) that advance together.
STEPS = 1 << 18
INDEX = "n_docs long, n_terms long, vocabulary binary, docs binary, postings binary"
_NONE = -1


def _pack(*parts: bytes) -> bytes:
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return zstandard.ZstdCompressor(level=3).compress(np.int64(len(parts)).tobytes() + sizes.tobytes() + b"".join(parts))


def _unpack(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ends = 8 + 8 * n + np.cumsum(np.frombuffer(raw, np.int64, n, 8))
    return [raw[a:b] for a, b in zip([8 + 8 * n, *ends[:-1].tolist()], ends.tolist())]


def _shard(ids: list[int | None], lens: list[int], codes: list[int], vocabulary: dict[bytes, int]) -> tuple:
    """An index row of some documents that have terms; documents by ascending id, those without one last."""
    n, count = len(ids), np.array(lens, dtype=np.int64)
    known = np.array([i is not None for i in ids], dtype=bool)
    number = np.array([i or 0 for i in ids], dtype=np.int64)
    order = np.lexsort((number, ~known))
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    at = np.fromiter(codes, dtype=np.int64, count=len(codes)) * n + np.repeat(place, count)
    pairs, tf = np.unique(at, return_counts=True)
    df = np.bincount(pairs // n, minlength=len(vocabulary))
    docs = _pack(number[order[: known.sum()]].tobytes(), count[order].tobytes())
    postings = _pack((pairs % n).astype(np.uint32).tobytes(), tf.astype(np.uint32).tobytes())
    return n, int(count.sum()), _pack(b"\n".join(vocabulary), df.astype(np.uint32).tobytes()), docs, postings


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: a row a shard, of all documents and all their terms."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lens, codes, vocabulary, size = [], [], [], {}, 0

        def emit() -> pa.RecordBatch:
            made = _shard(ids, lens, codes, vocabulary)
            return pa.RecordBatch.from_pylist([dict(zip(("n_docs", "n_terms", "vocabulary", "docs", "postings"), made))], schema=pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), *((c, pa.binary()) for c in ("vocabulary", "docs", "postings"))]))

        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = data.as_py() or b""
                terms = words(text)
                if not terms:
                    continue
                if ids and size + len(text) > SHARD_BYTES:
                    yield emit()
                    ids, lens, codes, vocabulary, size = [], [], [], {}, 0
                ids.append(i)
                lens.append(len(terms))
                codes += [vocabulary.setdefault(t, len(vocabulary)) for t in terms]
                size += len(text)
        if ids:
            yield emit()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(scan, INDEX)


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(1000000000 tf) div (1000 tf + 12 m), where m = 75 + (25 n N) div L; a term's weight multiplies it."""
    m = 100 - 25 + 25 * length * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def weight(n_docs: int, df: int) -> int:
    """floor(1000 ln((2 N + 2) / (2 df + 1))), 0 for a term of all documents."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def treap(priority: list[int], left: list[int], right: list[int], base: int) -> int:
    """Sets the children of the nodes ``base``, ``base`` + 1, ... (in search order) and returns the root."""
    spine: list[int] = []
    for i, p in enumerate(priority):
        last = _NONE
        while spine and priority[spine[-1]] < p:
            last = spine.pop()
        if last != _NONE:
            left[base + i] = base + last
        if spine:
            right[base + spine[-1]] = base + i
        spine.append(i)
    return base + spine[0]


@dataclass
class Forest:
    """Treaps of some terms of a shard, node after node by term and document."""

    ids: np.ndarray
    doc: np.ndarray
    impact: np.ndarray
    left: np.ndarray
    right: np.ndarray
    term: np.ndarray
    key: np.ndarray
    root: dict[bytes, int]

    def inside(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """From each node down to the root of what its subtree holds in lo..hi, or none."""
        node = node.copy()
        at = np.flatnonzero(node != _NONE)
        while len(at):
            doc = self.doc[node[at]]
            after, before = doc > hi[at], doc < lo[at]
            off = after | before
            at, after = at[off], after[off]
            node[at] = np.where(after, self.left[node[at]], self.right[node[at]])
            at = at[node[at] != _NONE]
        return node

    def at(self, node: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Impact of ``doc`` for the term of each node, 0 where it lacks the term."""
        key = self.term[node] * len(self.ids) + doc
        where = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[where] == key, self.impact[where], 0)


def plant(row: dict, weights: dict[bytes, int], n_docs: int, n_terms: int) -> Forest | None:
    """The treaps of the weighted terms in an index row; None if it has none of them."""
    raw, df = _unpack(row["vocabulary"])
    number, length = _unpack(row["docs"])
    ids, length = np.frombuffer(number, np.int64), np.frombuffer(length, np.int64)
    doc, tf = (np.frombuffer(x, np.uint32).astype(np.int64) for x in _unpack(row["postings"]))
    end = np.cumsum(np.frombuffer(df, np.uint32).astype(np.int64))
    asked = [(t, int(end[i - 1]) if i else 0, int(end[i])) for i, t in enumerate(raw.split(b"\n")) if weights.get(t)]
    if not asked or not len(ids):
        return None
    take = np.concatenate([np.arange(a, b) for _, a, b in asked])
    term = np.repeat(np.arange(len(asked)), [b - a for _, a, b in asked])
    take, term = take[known := doc[take] < len(ids)], term[known]  # documents without id are last
    doc, tf = doc[take], tf[take]
    base = impacts(tf, length[doc], n_docs, n_terms)
    tie = (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
    priority = (base << 24 | tie).tolist()
    left, right, root = [_NONE] * len(doc), [_NONE] * len(doc), {}
    cut = np.searchsorted(term, np.arange(len(asked) + 1)).tolist()
    for (t, _, _), a, b in zip(asked, cut, cut[1:]):
        if a < b:
            root[t] = treap(priority[a:b], left, right, a)
    w = np.array([weights[t] for t, _, _ in asked], dtype=np.int64)
    return Forest(ids, doc, base * w[term], np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), term, term * len(ids) + doc, root)


class Best:
    """The k best (score, id) of each of some queries: higher score first, then smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.query, self.score, self.id = (np.empty(0, dtype=np.int64) for _ in range(3))
        self.least, self.last = np.zeros(queries, dtype=np.int64), np.full(queries, np.iinfo(np.int64).min)

    def enters(self, query: np.ndarray, score: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
        """Whether a document of at most this score and at least this id can enter; a score of 0 cannot."""
        least = self.least[query]
        return (score > least) | (score == least) & (score > 0) & (doc_id < self.last[query])

    def offer(self, query: np.ndarray, score: np.ndarray, doc_id: np.ndarray) -> None:
        some = self.enters(query, score, doc_id)
        if not some.any():
            return
        q, s, i = (np.concatenate(x) for x in ((self.query, query[some]), (self.score, score[some]), (self.id, doc_id[some])))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.concatenate(([True], q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        keep = rank < self.k
        full = np.flatnonzero(rank == self.k - 1)
        self.query, self.score, self.id = q[keep], s[keep], i[keep]
        self.least[q[full]], self.last[q[full]] = s[full], i[full]


def walk(forest: Forest, queries: list[dict[bytes, int]], best: Best) -> int:
    """All queries through the treaps of a shard, into ``best``; returns how many documents were scored."""
    entries = [(q, forest.root[t], n) for q, terms in enumerate(queries) for t, n in terms.items() if t in forest.root]
    if not entries:
        return 0
    query, node, times = (np.array(x, dtype=np.int64) for x in zip(*entries))
    which, step = np.unique(query, return_inverse=True)
    scored = 0
    # Steps: query, lo, hi; entries by step: step, node, times.
    waiting = [(which, np.zeros(len(which), dtype=np.int64), np.full(len(which), len(forest.ids) - 1), step, node, times)]
    while waiting:
        query, lo, hi, step, node, times = waiting.pop()
        first = np.searchsorted(step, np.arange(len(query)))
        value = times * forest.impact[node]
        bound = np.add.reduceat(value, first)
        alive = best.enters(query, bound, forest.ids[lo])
        if not alive.all():
            keep = alive[step]
            query, lo, hi, node, times, value = query[alive], lo[alive], hi[alive], node[keep], times[keep], value[keep]
            step = (np.cumsum(alive) - 1)[step[keep]]
            bound = bound[alive]
            if not len(query):
                continue
            first = np.searchsorted(step, np.arange(len(query)))
        if len(step) > STEPS and len(query) > 1:
            # The more promising half goes first.
            half = np.argsort(-bound, kind="stable")
            for part in (np.sort(half[len(half) // 2 :]), np.sort(half[: len(half) // 2])):
                chosen = np.zeros(len(query), dtype=bool)
                chosen[part] = True
                keep = chosen[step]
                waiting.append((query[part], lo[part], hi[part], (np.cumsum(chosen) - 1)[step[keep]], node[keep], times[keep]))
            continue
        largest = np.maximum.reduceat(value, first)
        pivot = np.minimum.reduceat(np.where(value == largest[step], forest.doc[node], len(forest.ids)), first)
        score = np.add.reduceat(times * forest.at(node, pivot[step]), first)
        best.offer(query, score, forest.ids[pivot])
        scored += len(query)
        lo, hi = np.concatenate((lo, pivot + 1)), np.concatenate((pivot - 1, hi))
        step = np.concatenate((step, step + len(query)))
        node = forest.inside(np.concatenate((node, node)), lo[step], hi[step])
        query, times = np.concatenate((query, query)), np.concatenate((times, times))
        keep = node != _NONE
        step, node, times = step[keep], node[keep], times[keep]
        some = np.zeros(len(query), dtype=bool)
        some[step] = True
        if some.any():
            waiting.append((query[some], lo[some], hi[some], (np.cumsum(some) - 1)[step], node, times))
    return scored


def _frequencies(index: DataFrame, asked: set[bytes]) -> dict[bytes, int]:
    """In how many documents each asked term occurs; the postings are not read."""
    sent = index.sparkSession.sparkContext.broadcast(asked)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for data in batch.column(0):
                raw, df = _unpack(data.as_py())
                for t, n in zip(raw.split(b"\n"), np.frombuffer(df, np.uint32).tolist()):
                    if t in sent.value:
                        total[t] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "df"])

    made = index.select("vocabulary").mapInArrow(count, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r.term): r.df for r in made.collect()}


def _search_block(index: DataFrame, items: list[tuple[object, bytes]], n_docs: int, n_terms: int, k: int, item_type: str) -> DataFrame:
    """Each task's k best documents of each item."""
    terms: dict[object, Counter] = {}
    for item, text in items:
        terms.setdefault(item, Counter()).update(words(text))
    df = _frequencies(index, set().union(*terms.values()) if terms else set())
    weights = {t: weight(n_docs, n) for t, n in df.items()}
    names = list(terms)
    queries = [{t: n for t, n in terms[i].items() if weights.get(t)} for i in names]
    sent = index.sparkSession.sparkContext.broadcast((weights, queries))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries = sent.value
        best = Best(len(queries), k)
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                if forest := plant(row, weights, n_docs, n_terms):
                    walk(forest, queries, best)
        yield pa.RecordBatch.from_arrays([pa.array(best.query), pa.array(best.id), pa.array(best.score)], names=["query", "doc_id", "score"])

    found = index.select("vocabulary", "docs", "postings").mapInArrow(task, "query long, doc_id long, score long")
    named = index.sparkSession.createDataFrame(list(enumerate(names)), f"query long, item_id {item_type}")
    return found.join(F.broadcast(named), "query").select("item_id", "doc_id", "score")  # a row an item of the block


def search(index: DataFrame, items: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item with a score above 0."""
    prepare(index.sparkSession)
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    asked = items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    total = asked.agg(F.sum((F.octet_length("text") + 1) / 2)).first()[0] or 0  # words are at most half the bytes
    blocks = max(1, math.ceil(total / block_terms))
    part = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    kind = dict(asked.dtypes)["item_id"]
    found = None
    for b in range(blocks):
        rows = [(r.item_id, bytes(r.text)) for r in asked.where(part == b).collect()]  # about block_terms words
        some = _search_block(index, rows, n_docs, n_terms, k, kind)
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 20, **columns) -> DataFrame:
    """``search`` over a new index of ``docs``, written to the checkpoint folder."""
    prepare(docs.sparkSession)
    return search(staged(build(docs), "treaps-index"), items, k, **columns)
