"""Importance resampling of documents towards a target distribution over hashed word n-grams.

A text's features are all its runs of 1 to ``n`` consecutive words, hashed by CRC-32 into
buckets. A word's CRC is computed once where it stands; those of longer runs are composed from
it by the CRC's combination algebra (`crc`), and no n-gram is ever spelled out. Two scans of
the documents: bucket counts (tasks add up their own and send a row a bucket), then a weight
each, the mean log ratio of target and corpus over its features. Gumbel noise from a hash of the
id turns the weights into a draw without replacement: the highest scores are the draw.

What reaches the driver is the counts by bucket, whose number is a parameter. Ranks come from
a range sort written to the checkpoint folder and the sizes of its parts.

Defined results: a null or empty text has no features and weight 0. A null id is the empty text
in the hash and comes last among equal scores. Repeated rows are documents each; rows equal in
id and score are ranked one after the other in any order. Other columns are left alone. An empty
corpus gives no rows; with an empty target the weights follow from zero counts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameseek.llm import crc
from frameseek.llm.common import prepare, staged
from frameseek.llm.terms import LOWER, NOT_WORD, spans

#: Bytes of text that are hashed together; longer texts go by pieces of about this size, cut between words.
PIECE = 2_000_000


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of the texts, parted by a byte that is no word's, and where each starts."""
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return LOWER[np.frombuffer(b"\0".join([*texts, b""]), dtype=np.uint8)], starts


def _pieces(texts: list[bytes | None]) -> Iterator[tuple[int, bool, list[bytes]]]:
    """(number of the first text, whether it goes on from the piece before, texts): short texts together, long ones cut between words."""
    some, size = [], 0
    for i, t in enumerate(texts):
        t = t or b""
        if len(t) <= PIECE:
            some.append(t)
            size += len(t) + 1
        if some and (size >= PIECE or len(t) > PIECE or i + 1 == len(texts)):
            yield i - len(some) + (len(t) <= PIECE), False, some
            some, size = [], 0
        at = 0
        while len(t) > PIECE and at < len(t):
            cut = NOT_WORD.search(t, at + PIECE)
            end = cut.start() if cut else len(t)
            yield i, at > 0, [t[at:end]]
            at = end


def features(texts: list[bytes | None], n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text's number, bucket) of every feature, some texts or a piece of a long one at a time."""
    for first, goes_on, some in _pieces(texts):
        buf, starts = _laid(some)
        at, end = spans(buf)
        text = first + np.searchsorted(starts, at, side="right") - 1
        word, length, old = crc.of_runs(buf, at, end), end - at, 0
        if goes_on:  # the last n - 1 words of the piece before lead into this one's runs
            word, length = np.concatenate([tail[0], word]), np.concatenate([tail[1], length])
            old = len(word) - len(text)
            text = np.full(len(word), first)
        runs = [(last[last >= old], c[last >= old]) for last, c in crc.ngrams(word, length, text, n)]
        keep = max(len(word) - (n - 1), 0)
        tail = word[keep:], length[keep:]
        yield text[np.concatenate([last for last, _ in runs])], np.concatenate([c for _, c in runs]) % np.uint32(buckets)


def bucket_counts(df: DataFrame, text_col: str = "text", n: int = 2, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how often the features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, bucket in features(batch.column(0).to_pylist(), n, buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = df.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def _as_array(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in counts.collect():  # a row a bucket
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the corpus."""
    s_all, t_all, buckets = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = [((t + 1.0) * (s_all + float(buckets))) / ((s + 1.0) * (t_all + float(buckets))) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor(-1000 ln(-ln u)), u in (0, 1) from the hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n: int = 2, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and a number that tells equal rows apart, for each document."""
    schema = "doc_id long, n_words long, n_features long, weight long, score long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            total, count = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
            for text, bucket in features(texts, n, len(gain)):
                np.add.at(total, text, gain[bucket])
                np.add.at(count, text, 1)
            # A text of w words has w + (w - 1) + ... features, up to n terms.
            words = np.array([_words(c, n) for c in count.tolist()], dtype=np.int64)
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            score = weight + np.array([noise(i, seed) for i in ids], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, count, weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    made = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(task, schema)
    return made.withColumn("row", F.monotonically_increasing_id())


def _words(count: int, n: int) -> int:
    """Words of a text with ``count`` features of 1 to n words."""
    if count >= n * (n + 1) // 2:
        return (count + n * (n - 1) // 2) // n
    w = 0
    while w * (w + 1) // 2 < count:
        w += 1
    return w


def ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``rank`` from 1 in ``order``: sorted in ranges, written, then counted by part; no task sees all rows."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_seq", F.monotonically_increasing_id())
    laid = staged(laid, "resample-order")
    split = laid.withColumn("_part", F.shiftright("_seq", 33)).withColumn("_at", F.col("_seq").bitwiseAND((1 << 33) - 1))
    # One row a part: the window is over as many rows as there are partitions.
    size = split.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = size.select("_part", before.alias("_before"))
    return split.join(F.broadcast(offset), "_part").withColumn("rank", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before", "_n", "_seq")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, n: int = 2, buckets: int = 10_000, seed: int = 7, text_col: str = "text", target_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; the rank is null where it is not drawn."""
    prepare(docs.sparkSession)
    counted = [_as_array(bucket_counts(d, c, n, buckets), buckets) for d, c in ((docs, text_col), (target, target_col))]
    rows = staged(weigh(docs, gains(*counted), id_col, text_col, n, seed), "resample-scores")
    eligible = rows.where(F.col("n_words") >= least_words)
    draw = eligible.count() * percent // 100
    placed = ranked(eligible, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    placed = placed.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank").cast("long")))
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).drop("row")
