"""Running numbers over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameseek.operators.staging import staged


def numbered(rows: DataFrame, order: list[Column], name: str = "row_id") -> DataFrame:
    """``rows`` with numbers from 0 in ``order``: sorted in ranges that are written down, then shifted by the sizes of those before.

    Rows equal in ``order`` are numbered in any order. The window is over a row a range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = staged(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_seq", F.monotonically_increasing_id()))
    split = laid.withColumns({"_part": F.shiftright("_seq", 33), "_at": F.col("_seq").bitwiseAND((1 << 33) - 1)})
    sizes = split.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_part").alias("_p"), before.alias("_before"))
    return split.join(F.broadcast(starts), F.col("_part") == F.col("_p")).withColumn(name, F.col("_before") + F.col("_at")).select(*rows.columns, name)


def placed(rows: DataFrame, group: str, order: list[Column], name: str = "n", row_id: str = "row_id") -> DataFrame:
    """``numbered`` by group and ``order``, with each row's place in its group from 1; a null group is a group and comes last."""
    every = staged(numbered(rows, [F.asc_nulls_last(group), *order], row_id))
    first = every.groupBy(F.col(group).alias("_g")).agg(F.min(row_id).alias("_first"))
    both = every.join(first, F.col(group).eqNullSafe(F.col("_g")))
    return both.withColumn(name, F.col(row_id) - F.col("_first") + 1).select(*rows.columns, row_id, name)
