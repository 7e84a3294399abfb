"""Exact top-k by exhaustive term-at-a-time accumulation.

A vector is a row of integer weights by dimension (its terms). Vectors are dealt into
blocks, each block's postings (per dimension: rows and weights) are scattered, weighted
with the query's weight of that dimension, into dense score arrays, one per query; a
partial selection keeps each query's best of the block, and a window merges the blocks.
Queries are dealt into blocks too, and every (query block, vector block) pair is one
task of bounded size: nothing is broadcast, nothing is skipped.

Quantised weights are floor(1024 * x) as 64-bit integers, exact while |x| < 2**40.

Defined results: vectors that are null, hold a null or non-finite component, or have
no id take no part. A query's own row is every row with its id; repeated query rows
are one query, repeated candidate rows are candidates each. Vectors of unequal length
are compared on the dimensions that both have. Ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameseek.llm.common import prepare

QUERY_BLOCK, VECTOR_BLOCK = 1024, 8192
CHUNK = 128  # queries accumulated at once


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    width = max(map(len, rows), default=0)
    if rows and all(len(r) == width for r in rows):
        return np.array(rows, dtype=np.int64).reshape(len(rows), width)
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def accumulate(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Scores of every query against every vector, dimension by dimension through its postings."""
    scores = np.zeros((len(queries), len(vectors)), dtype=np.int64)
    for d in range(min(queries.shape[1], vectors.shape[1])):
        rows, asked = np.flatnonzero(vectors[:, d]), np.flatnonzero(queries[:, d])
        if not len(rows) or not len(asked):
            continue
        if len(rows) == len(vectors) and len(asked) == len(queries):
            scores += queries[:, d, None] * vectors[None, :, d]
        else:
            scores[np.ix_(asked, rows)] += queries[asked, d, None] * vectors[None, rows, d]
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k best scores, ties by id, without the query's own row."""
    usable = np.flatnonzero(ids != own)
    s = scores[usable]
    if len(s) > k:
        usable = usable[s >= np.partition(s, len(s) - k)[len(s) - k]]
        s = scores[usable]
    return usable[np.lexsort((ids[usable], -s))[:k]]


def quantised(vector: str) -> Column:
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(1024.0) * x.cast("double")).cast("long"))


def finite(vector: str) -> Column:
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: the k best rows of ``vectors`` for each row where ``is_query`` holds."""
    prepare(vectors.sparkSession)
    rows = vectors.where(F.col(id_col).isNotNull() & finite(vector_col)).select(F.col(id_col).cast("long").alias("id"), quantised(vector_col).alias("w"), is_query.alias("q"))
    n, asked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0))).first()
    q_blocks, v_blocks = max(1, math.ceil(asked / QUERY_BLOCK)), max(1, math.ceil(n / VECTOR_BLOCK))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    queries = rows.where("q").dropDuplicates(["id"]).select("id", "w", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int").alias("qb"), every(v_blocks).alias("vb"))
    cands = rows.select("id", "w", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(v_blocks)).cast("int").alias("vb"), every(q_blocks).alias("qb"))

    def task(q: pa.Table, v: pa.Table) -> pa.Table:
        qi, vi = q.column("id").to_numpy(), v.column("id").to_numpy()
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        if len(qi) and len(vi):
            qm, vm = _matrix(q.column("w")), _matrix(v.column("w"))
            for at in range(0, len(qi), CHUNK):
                scores = accumulate(qm[at : at + CHUNK], vm)
                for i, own in enumerate(qi[at : at + CHUNK]):
                    top = best(scores[i], vi, own, k)
                    out.append((int(own), vi[top], scores[i][top]))
        sizes = [len(o[1]) for o in out]
        empty = np.empty(0, dtype=np.int64)
        return pa.table({"query_id": pa.array(np.repeat(np.array([o[0] for o in out], dtype=np.int64), sizes)), "id": pa.array(np.concatenate([o[1] for o in out] or [empty])), "score": pa.array(np.concatenate([o[2] for o in out] or [empty]))})

    found = queries.groupBy("qb", "vb").cogroup(cands.groupBy("qb", "vb")).applyInArrow(task, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
