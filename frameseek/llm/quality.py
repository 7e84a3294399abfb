"""Quality classification by compression.

Two zstandard dictionaries are built, from good and from bad labelled text. A text is
cut into 2 KiB pieces, each compressed with either dictionary; with G and B the summed
sizes, d = (B - G) / (B + G) is the normalised size difference, and a logistic curve
fitted on labelled documents that no dictionary saw turns d into a score.

Documented bound: at most ``per_class`` labelled documents of each class are used, 60 %
for the dictionaries, the rest for the curve. The sample is cut by hash of the id: a
class's count gives the hash below which about a quarter more than the bound are expected,
and of those the least hashes stay, so no class is ranked in one task.

Defined results: a null text is the empty text, with d = 0. Without labels of both
classes the score is the share of label 1 (0.5 without any). A document whose labels
contradict each other counts once for each label; of several texts under one id that
with the least MD5 is learned from. Repeated rows are scored each. Input columns named
difference, score or predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameseek.llm.common import prepare, sample_cut

PIECE = 2048
LEVEL = 3


def pieces(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    shift: float

    def compressors(self) -> tuple:
        out = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw or b"\0" * 8)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))
        return tuple(out)

    def score(self, difference: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * difference + self.shift, -40, 40))))


def difference(text: str | None, good, bad) -> float:
    """The normalised compressed-size difference of a whole text; above 0: more like the good text."""
    g = b = 0
    for p in pieces(text):
        g += len(good.compress(p))
        b += len(bad.compress(p))
    return (b - g) / (b + g) if g else 0.0


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the best logistic curve, by Newton's method with a light ridge."""
    scale = float(np.abs(x).max()) or 1.0
    design, w = np.column_stack((x / scale, np.ones(len(x)))), np.zeros(2)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ w, -40, 40)))
        h = (design * (p * (1 - p))[:, None]).T @ design + np.eye(2) * 1e-3
        step = np.linalg.solve(h, design.T @ (p - y) + 1e-3 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def train(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 1500, size: int = 65536, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from ``labels`` where ``usable`` holds; ``labels`` and ``docs`` share ``id_col``."""
    prepare(docs.sparkSession)
    known = labels.where(usable & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    known = known.withColumn("h", F.xxhash64("id"))
    # About 2.5 * per_class ids: bounded by the parameter.
    picked = F.broadcast(known.where(sample_cut(known, "y", "h", per_class)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id")
    found = texts.groupBy("y", "h", "id").agg(F.min_by("text", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("text")).collect()
    found = sorted(found, key=lambda r: (r.y, r.h, r.id))
    rows = [r for _, some in groupby(found, key=lambda r: r.y) for r in islice(some, per_class)]
    of = {c: [r.text for r in rows if r.y == c] for c in (0, 1)}
    if not of[0] or not of[1]:
        p = 0.5 if not rows else (0.999 if of[1] else 0.001)
        return Model(b"", b"", 0.0, float(np.log(p / (1 - p))))
    cut = {c: max(1, int(0.6 * len(of[c]))) for c in of}
    built = {c: dictionary([p for t in of[c][: cut[c]] for p in pieces(t)], size) for c in of}
    draft = Model(built[1], built[0], 0.0, 0.0)
    good, bad = draft.compressors()
    held = [(difference(t, good, bad), c) for c in of for t in of[c][cut[c] :] or of[c]]
    # The sample holds the classes as bounded above; weigh them back to their true shares.
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    slope, shift = logistic(np.array([h[0] for h in held]), np.array([float(h[1]) for h in held]))
    seen = {c: sum(1 for h in held if h[1] == c) for c in (0, 1)}
    shift += float(np.log(share[1] / share[0]) - np.log(seen[1] / seen[0]))
    return Model(built[1], built[0], slope, shift)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with difference, score and predicted in place of the text."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of 64 KiB
    added = ("difference", "score", "predicted")
    keep = [c for c in docs.columns if c != text_col and c not in added]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        good, bad = m.compressors()
        for batch in batches:
            d = [difference(t, good, bad) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            s = [m.score(x) for x in d]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(d, pa.float64()), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=[*keep, *added])

    return docs.mapInArrow(apply, schema.add("difference", "double").add("score", "double").add("predicted", "integer"))
