"""Greedy suppression in score order, exact, in rounds of dense blocks.

The rule is sequential: a row stays unless enough rows that stay before it in its group are near it.
A round takes the first ``block`` open rows of every group and decides a group's in one task (small
groups share a task), with the number of near kept rows that each brings along; then the rows still open meet the rows
just kept, in blocks of both, add to their numbers and drop out once that suffices. So a
group's rows are never all in one task, no pair of near rows is written, and copies of what was
kept leave early: a group takes as many rounds as it keeps blocks. Every round's open rows are
written to the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameseek.operators.staging import staged

#: Rows of a group that are decided in one round, and that meet them in one task: 2048 x 2048 comparisons are 32 MB.
BLOCK = 2048
#: Rows that one call decides, of as many groups as that holds.
SHARE = 32_768

#: From two matrices, a row a row of values, to the matrix of what is near.
Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def cosine(least: float) -> Near:
    """Unit vectors whose inner product, rounded to six places, reaches ``least``."""
    return lambda a, b: np.floor(a @ b.T * 1e6 + 0.5) >= round(least * 1e6)


def closer(gap: float) -> Near:
    """Single values less than ``gap`` apart."""
    return lambda a, b: np.abs(a - b.T) < gap


def overlap(least: float) -> Near:
    """Boxes (y0, x0, y1, x1) whose intersection over union is above ``least``; boxes without area overlap none."""

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        side = lambda lo, hi: np.maximum(np.minimum(a[:, None, hi], b[None, :, hi]) - np.maximum(a[:, None, lo], b[None, :, lo]), 0)
        area = lambda x: np.maximum(x[:, 2] - x[:, 0], 0) * np.maximum(x[:, 3] - x[:, 1], 0)
        both = side(0, 2) * side(1, 3)
        union = area(a)[:, None] + area(b)[None, :] - both
        return (union > 0) & (both > least * union)

    return near


def decide(values: np.ndarray, near: Near, count: np.ndarray, keep: int) -> np.ndarray:
    """Which rows stay, in order, when ``count`` near rows before them stay already."""
    if len(values) == 1:
        return count < keep
    close, count, kept = near(values, values), count.copy(), np.zeros(len(values), dtype=bool)
    for i in range(len(values)):
        if count[i] < keep:
            kept[i] = True
            count[i + 1 :] += close[i, i + 1 :]
    return kept


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def suppress(rows: DataFrame, by: list[str], score: str, key: str, values: Column, near: Near, keep: int = 1, block: int = BLOCK) -> DataFrame:
    """The rows that stay: by falling ``score``, then rising ``key``, a row goes when ``keep`` staying rows of its group are near it.

    ``values`` is an array, of one length in all rows. Rows without it, or with a null or non-finite entry, are near
    none and stay. Null keys of ``by`` are a group; null scores come last; rows equal in score and key in any order.
    """
    names = rows.columns
    base = rows.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("g"), F.col(score).alias("s"), F.col(key).alias("t"), values.cast("array<double>").alias("v"))
    base = staged(base.withColumn("i", F.monotonically_increasing_id()))
    able = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    able = F.coalesce(able, F.lit(False))
    widths = [r[0] for r in base.where(able).select(F.size("v")).distinct().limit(2).collect()]
    if len(widths) > 1:
        raise ValueError("values differ in length")
    width = widths[0] if widths else 1
    kind = dict(base.dtypes)
    state = f"g string, s {kind['s']}, t {kind['t']}, v array<double>, i long, n long"
    chosen = "g string, i long, v array<double>, kept boolean"

    def first(tbl: pa.Table) -> pa.Table:
        tbl = tbl.sort_by([("g", "ascending"), ("r", "ascending")])
        values, count = _matrix(tbl["v"], width), tbl["n"].to_numpy()
        starts = np.flatnonzero(tbl["r"].to_numpy() == 1).tolist()
        kept = np.concatenate([decide(values[a:b], near, count[a:b], keep) for a, b in zip(starts, [*starts[1:], len(count)])])
        return tbl.select(["g", "i", "v"]).append_column("kept", pa.array(kept))

    def later(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select(["g", "s", "t", "v", "i", "n"])
        if left.num_rows and right.num_rows:
            more = near(_matrix(left["v"], width), _matrix(right["v"], width)).sum(axis=1)
            left = left.set_column(5, "n", pa.array(left["n"].to_numpy() + more))
            left = left.filter(pa.array(left["n"].to_numpy() < keep))
        return left

    open_, stay = base.where(able).select("g", "s", "t", "v", "i", F.lit(0).cast("long").alias("n")), []
    order = Window.partitionBy("g").orderBy(F.col("s").desc_nulls_last(), F.col("t").asc_nulls_last(), "i")
    while not open_.isEmpty():
        head = open_.withColumn("r", F.row_number().over(order)).where(F.col("r") <= block)
        shares = F.pmod(F.xxhash64("g"), F.lit(-(-open_.count() // SHARE)))
        decided = staged(head.groupBy(shares.alias("b")).applyInArrow(first, chosen))
        stay.append(decided.where("kept").select("i"))
        rest = open_.join(decided.select("i"), "i", "left_anti")
        chunks = staged(rest.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).alias("m")))
        if chunks.isEmpty():
            break
        spread = rest.join(chunks, "g").withColumn("b", F.pmod(F.xxhash64("i"), "m"))
        copies = decided.where("kept").join(chunks, "g").select("g", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("b"))
        open_ = staged(spread.drop("m").groupBy("g", "b").cogroup(copies.groupBy("g", "b")).applyInArrow(later, state))
    free = base.where(~able)
    kept = base.join(reduce(DataFrame.union, stay), "i", "left_semi").select(*base.columns).union(free) if stay else free
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
