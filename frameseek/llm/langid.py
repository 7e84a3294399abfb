"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the lower-cased text with runs of non-letters
as one space: (1 + ln tf) * idf, L2-normalised. Document frequencies are counted over
all training documents. Weights are learned by follow-the-regularised-leader
(FTRL-proximal) with L1 and L2 penalties, and a temperature fitted on a part of the
sample that the weights did not see calibrates the probabilities.

Documented bound: the weights are fitted on at most ``per_language`` documents of each
language; whole texts are used. The sample is cut by hash of id and text: a language's
count gives the hash below which about a quarter more than the bound are expected, and
of those the least hashes stay. So no language's rows are ranked in one task, and rows
equal in id and text are one. Languages are few: the model holds DIM weights of each.

Defined results: a text that is null or has no letter is ``und`` with score 0. Without
any training document every text is ``und``. Equal scores go to the language that
comes first by code point. Repeated rows are predicted each. Input columns named
lang_pred or score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameseek.llm.common import prepare, sample_cut

#: Hash buckets of the 1-, 2- and 3-grams.
SIZES = (1 << 12, 1 << 14, 1 << 15)
OFFSETS = (0, SIZES[0], SIZES[0] + SIZES[1])
DIM = sum(SIZES)
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_alpha: list[np.ndarray] = []


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of non-letters one space."""
    if not _alpha:
        _alpha.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    cp = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    cp = np.where(_alpha[0][cp], cp, np.uint32(32))
    cp = np.concatenate((np.array([32], dtype=np.uint32), cp, np.array([32], dtype=np.uint32)))
    keep = np.ones(len(cp), dtype=bool)
    keep[1:] = (cp[1:] != 32) | (cp[:-1] != 32)
    return cp[keep]


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, term frequencies) of a whole text."""
    c = _letters(text)
    one = c * np.uint32(0x9E3779B1)
    two = one[:-1] + c[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
    found = []
    for h, size, offset in zip((one, two, three), SIZES, OFFSETS):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        found.append((h >> np.uint32(33 - size.bit_length())).astype(np.int64) + offset)
    tf = np.bincount(np.concatenate(found), minlength=DIM)
    idx = np.flatnonzero(tf)
    return idx, tf[idx]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        idx, val = vector(*counts(text), self.idf)
        z = (val @ self.weights[idx] + self.bias) / self.temperature
        e = np.exp(z - z.max())
        best = int(e.argmax())
        return self.languages[best], float(e[best] / e.sum())


def vector(idx: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    val = (1.0 + np.log(tf)) * idf[idx]
    norm = np.sqrt(val @ val)
    return idx, val / norm if norm else val


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal for the softmax loss; row DIM holds the bias, which L1 spares."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))
    order = np.random.default_rng(seed)

    def weights(at: np.ndarray, free: bool = True) -> np.ndarray:
        pull = np.full(len(at), l1)
        pull[-1] = 0.0 if free else l1
        zi = z[at]
        w = -(zi - np.sign(zi) * pull[:, None]) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zi) <= pull[:, None], 0.0, w) if l1 else w

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = np.append(rows[i][0], DIM), np.append(rows[i][1], 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            g = x[:, None] * p
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / alpha * w
    w = weights(np.arange(DIM + 1))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that gives held-apart rows the least log loss."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(10.0), 200))

    def loss(t: float) -> float:
        s = logits / t
        m = s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s - m).sum(axis=1)) + m[:, 0] - s[np.arange(len(y)), y]).mean())

    return float(min(grid, key=loss))


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600) -> Model:
    """Learn from the rows where ``usable`` holds and the language is known."""
    prepare(docs.sparkSession)
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                if has_letter(text):
                    df[counts(text)[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, DIM)), pa.array(np.append(df[at], n))], names=["feature", "df"])

    # At most DIM + 1 sums reach the driver, whatever the corpus.
    seen = rows.select(text_col).mapInArrow(frequencies, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(DIM + 1)
    df[seen["feature"].to_numpy()] = seen["df"].to_numpy()
    idf = np.log((1.0 + df[DIM]) / (1.0 + df[:DIM])) + 1.0

    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    cut = sample_cut(rows, "lang", "h", per_language)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, text, lang in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if has_letter(text):
                    at, tf = counts(text)
                    out.append((h, lang, at.astype(np.int32).tobytes(), tf.astype(np.int32).tobytes()))
            if out:
                d, la, a, t = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(la, pa.string()), pa.array(a, pa.binary()), pa.array(t, pa.binary())], names=["h", "lang", "at", "tf"])

    # About 1.25 * per_language rows of a language reach the driver.
    chosen = rows.where(cut).select("h", "text", "lang").mapInArrow(features, "h long, lang string, at binary, tf binary")
    found = sorted(chosen.dropDuplicates(["h", "lang"]).collect(), key=lambda r: (r.lang, r.h))
    sample = [r for _, some in groupby(found, key=lambda r: r.lang) for r in islice(some, per_language)]
    languages = sorted({r.lang for r in sample})
    x = [vector(np.frombuffer(r.at, dtype=np.int32), np.frombuffer(r.tf, dtype=np.int32), idf) for r in sample]
    y = np.array([languages.index(r.lang) for r in sample], dtype=np.int64)
    if len(languages) < 2:
        return Model(languages, idf, np.zeros((DIM, len(languages))), np.zeros(len(languages)), 1.0)
    apart = np.random.default_rng(11).random(len(x)) < 0.2
    w, b = ftrl([v for v, a in zip(x, apart) if not a], y[~apart], len(languages))
    logits = np.array([v @ w[i] + b for (i, v), a in zip(x, apart) if a]).reshape(-1, len(languages))
    return Model(languages, idf, w, b, temperature(logits, y[apart]))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score in place of the text."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x languages floats
    keep = [c for c in docs.columns if c != text_col and c not in ("lang_pred", "score")]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = [m.predict(t) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.mapInArrow(apply, schema.add("lang_pred", "string").add("score", "double"))
