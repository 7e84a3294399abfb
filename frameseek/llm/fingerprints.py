"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct 5-word shingle hash below a fixed fraction of the hash
range. The fraction is the whole range: short texts have few shingles, and likeness and
containment of their sketches are exact; with a smaller fraction they are estimates. A
text with words but no hash below the threshold keeps its least hash, which lies above
the threshold and is thereby told apart: `merge` drops it as soon as the union has a
hash below, and keeps the least of such hashes otherwise, so the merge of two sketches
is the sketch of all their shingles. The share of one sketch's hashes found in the
other is containment, and their resemblance likeness.

A fingerprint is the sketch as text: the leading 48 bits of the kept hashes in ascending
order, base64. Equal texts have equal fingerprints; a text without words has the empty
fingerprint "".

Defined results: a null text is the empty text. Two empty sketches have likeness and
containment 1, an empty and a non-empty one 0. Documents are ordered by id (nulls
first; rows with one id by the MD5 of their texts), and the one after the last is the
first.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameseek.llm.common import parts_for, prepare, total_chars
from frameseek.llm.hashing import shingle_hashes, word_hashes

#: One hash in 2**FRACTION_BITS is kept.
FRACTION_BITS = 0
#: Characters of text in one range of the document order.
RANGE_CHARS = 64_000_000
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double,"
    " contained_edited double, contained_next double"
)


def _kept(values: np.ndarray, bits: int) -> np.ndarray:
    """Of ascending distinct 48-bit values those below the threshold; the least if there is none."""
    below = values[values < np.uint64(1 << (48 - bits))]
    return below if len(below) else values[:1]


def sketch(text: str, k: int = 5, bits: int = FRACTION_BITS) -> np.ndarray:
    """Ascending 48-bit values of the kept shingle hashes."""
    return _kept(np.unique(shingle_hashes(word_hashes(text.encode()), k) >> np.uint64(16)), bits)


def to_text(values: np.ndarray) -> str:
    raw = np.ascontiguousarray(values.astype(">u8")).view(np.uint8).reshape(-1, 8)
    return base64.b64encode(np.ascontiguousarray(raw[:, 2:]).tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), dtype=np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, 2:] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, bits: int = FRACTION_BITS) -> np.ndarray:
    """Sketch of two texts' shingles together."""
    return _kept(np.union1d(a, b), bits)


def compare(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(likeness, containment of a in b) as the sketches estimate them."""
    if not len(a) or not len(b):
        both = float(len(a) == len(b))
        return both, both
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common), common / len(a)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order with each bucket's successor as a guest at its end; one row of lookahead."""
    held = None
    for batch in batches:
        out: list[tuple] = []
        for doc, text, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "guest"))):
            own = None if guest and held is None else (doc, text, sketch(text))
            if held is not None:
                at, before, was = held
                n = len(before)
                q = n // 4
                edited = before[: n - q] + text[:q]
                new = sketch(edited) if q else was
                (near, inside), (near_next, inside_next) = compare(was, new), compare(was, own[2])
                out.append((at, n, hashlib.sha256(edited.encode()).hexdigest(), to_text(was), to_text(new), near, near_next, inside, inside_next))
            held = None if guest else own
        if out:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4)
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names=names)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form (the last quarter replaced by the next text's start).

    The next document is found without a global sort in one task: the keys alone (id and
    MD5 of the text, so a hot id is many keys) are cut into ranges, each range gets its
    successor's first row as a guest, and one shuffle by range brings the rows together.
    One key for RANGE_CHARS of text is gathered.
    """
    prepare(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The id as hexadecimal digits in its numeric order, then the text's digest.
    number = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    d = d.withColumn("key", F.concat(F.coalesce(number, F.lit("")), F.lit(":"), F.md5(F.col("text").cast("binary"))))
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts_for(total_chars(docs, text_col), RANGE_CHARS))
    keys = d.select("key").repartitionByRange(ranges, "key").select("key", F.spark_partition_id().alias("p"))
    heads = sorted(r["key"] for r in keys.groupBy("p").agg(F.min("key").alias("key")).collect())
    shared = docs.sparkSession.sparkContext.broadcast(np.array(heads, dtype="S49"))

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, key.to_numpy(dtype="S49"), side="right") - 1)

    placed = d.withColumn("bucket", place("key"))
    of_head = docs.sparkSession.createDataFrame([(k, (i - 1) % len(heads)) for i, k in enumerate(heads)], "head string, to int")
    # The rows of one key are equal; heads are as many as ranges, 60 bytes each.
    guests = placed.drop("bucket").join(F.broadcast(of_head), F.col("key") == F.col("head"))
    guests = guests.groupBy(F.col("to").alias("bucket"), "key").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    rows = placed.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    dealt = rows.repartition(max(len(heads), 1), "bucket").sortWithinPartitions("bucket", "guest", "key")
    return dealt.select("doc_id", "text", "guest").mapInArrow(_pairs, SCHEMA)
