"""Dense vectors: exact cosine search, hubness, query expansion, normalisation.

Rows and queries are dealt into blocks by a hash; a task multiplies one block of rows
with one block of queries as numpy matrices and folds the scores at once (k best, sums),
so neither side goes through the driver and no pair leaves its task unfolded. A row is
copied once for each block of queries, a query once for each block of rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows and queries of a block: 4096 x 4096 scores are 128 MiB in a task.
ROW_BLOCK = QUERY_BLOCK = 4096


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product in double precision, in the order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: str) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def encoded(v: str) -> Column:
    """Any of the first eight components is not zero."""
    return F.exists(F.slice(v, 1, 8), lambda x: x != 0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A row a vector; null components are not a number. Vectors of several lengths are an error."""
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != lengths[0]).any():
        raise ValueError(f"vectors of {lengths.min()} and {lengths.max()} components")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lengths), -1)


def rounded(x: np.ndarray, places: int = 6) -> np.ndarray:
    """Halves go away from zero, as in SQL."""
    return np.copysign(np.floor(np.abs(x) * 10**places + 0.5), x) / 10**places


def tiles(rows: DataFrame, queries: DataFrame, fold: Callable, schema: str, deal: str = "qid", within: str | None = None) -> DataFrame:
    """What ``fold`` makes of each block of scores; rows: row_id, v, ...; queries: qid, v, ...

    ``fold(r, q, s)`` gets the other columns of both blocks as Arrow tables, the rows by id, and the scores,
    a row of ``s`` a row; it returns arrays in the order of ``schema``. A score that is not finite (as with a null component) is -inf. Vectors of several lengths are an error. Queries of one value of ``deal`` share a block. With ``within`` only rows and queries
    of the same value of that column meet; nulls there meet none. Null vectors take no part.
    """
    key = F.col(within) if within else F.lit(0)
    # New names of the same: both sides may be one table.
    r, q = (d.where("v is not null").select(*[F.col(c).alias(c) for c in d.columns], key.alias("_g")) for d in (rows, queries))
    blocks = r.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / ROW_BLOCK).alias("_nr"))
    blocks = blocks.join(q.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("_nq")), "_g")
    # Without groups this is one row: its size is proven.
    blocks = blocks if within else F.broadcast(blocks)
    r, q = r.join(blocks, "_g"), q.join(blocks, "_g")
    r = r.withColumn("_r", F.pmod(F.xxhash64("row_id"), "_nr")).withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nq") - 1)))
    q = q.withColumn("_q", F.pmod(F.xxhash64(deal), "_nq")).withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nr") - 1)))
    made = to_arrow_schema(StructType.fromDDL(schema))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return made.empty_table()
        left = left.sort_by("row_id")
        a, b = _matrix(left["v"]), _matrix(right["v"])
        if a.shape[1] != b.shape[1]:
            raise ValueError(f"vectors of {a.shape[1]} and {b.shape[1]} components")
        with np.errstate(invalid="ignore"):
            s = a @ b.T
        s[~np.isfinite(s)] = -np.inf
        return pa.table(dict(zip(made.names, fold(left, right, s))), schema=made)

    sides = [d.drop("_nr", "_nq").groupBy("_g", "_r", "_q") for d in (r, q)]
    return sides[0].cogroup(sides[1]).applyInArrow(block, schema)


def best(r: pa.Table, q: pa.Table, s: np.ndarray, k: int, qid: str = "qid") -> list:
    """The k best rows of each column of ``s`` as (qid, row_id, score); of equal scores at the cut those of the smallest ids."""
    cut = np.partition(s, max(len(s) - k, 0), axis=0)[max(len(s) - k, 0)]
    keep = s >= cut
    for c in np.flatnonzero(keep.sum(axis=0) > k):
        tied = np.flatnonzero(s[:, c] == cut[c])
        keep[tied[k - int((s[:, c] > cut[c]).sum()) :], c] = False
    at, of = np.nonzero(keep & np.isfinite(s))
    return [q[qid].take(pa.array(of)), r["row_id"].take(pa.array(at)), pa.array(s[at, of])]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, exclude_same: str | None = None) -> DataFrame:
    """(qid, row_id, score, rank) of the k best cosines; vectors: row_id, v[, key]; queries: qid, v[, key].

    ``exclude_same`` names a column of both whose equal values do not match.
    """

    def fold(r: pa.Table, q: pa.Table, s: np.ndarray) -> list:
        if exclude_same:
            s[r[exclude_same].to_numpy()[:, None] == q[exclude_same].to_numpy()[None, :]] = -np.inf
        return best(r, q, rounded(s), k)

    extra = [exclude_same] if exclude_same else []
    found = tiles(vectors.select("row_id", "v", *extra), queries.select("qid", "v", *extra), fold, "qid long, row_id long, score double")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def weighted_sum(df: DataFrame, by: list[str], vector: str, weight: Column) -> DataFrame:
    """Per group the weighted sum of vectors, as an array ordered by position."""
    parts = df.select(*by, F.posexplode(vector).alias("pos", "x"), weight.alias("w"))
    sums = parts.groupBy(*by, "pos").agg(F.sum(F.col("x").cast("double") * F.col("w")).alias("s"))
    return sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda e: e["s"]).alias("v"))
