"""Work dealt to bins, longest first into the least filled one, without a task that sees all of it.

Equal sizes fill bins in a pattern: first those that are behind, then all in turn. So the rule is
followed over the distinct sizes, a row each, and every item finds its bin by its place among the
items of its size.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameseek.operators.numbering import placed


def plan(sizes: list[tuple[int, int]], bins: int) -> list[tuple[int, list[int], list[int]]]:
    """For sizes with their numbers, largest first: (size, bins of the first items, bins that then take turns)."""
    load, out = [0] * bins, []
    for size, many in sizes:
        first, heap = [], [(x, b) for b, x in enumerate(load)]
        heapq.heapify(heap)
        # Once no bin is further behind than one item, the order repeats.
        while len(first) < many and (size > 0 and max(load) - heap[0][0] > size):
            x, b = heapq.heappop(heap)
            first.append(b)
            load[b] = x + size
            heapq.heappush(heap, (load[b], b))
        turn, left = [], many - len(first)
        for _ in range(min(left, 2 * bins)):
            x, b = heapq.heappop(heap)
            turn.append(b)
            load[b] = x + size
            heapq.heappush(heap, (load[b], b))
        # The first round puts the bins in order, the second is what repeats.
        first, turn, left = first + turn[:bins], turn[bins:], left - min(left, 2 * bins)
        for b in range(bins) if left else ():
            at = turn.index(b) if b in turn else bins
            load[b] += size * (left // bins + (at < left % bins))
        out.append((size, first, turn))
    return out


def longest_first(items: DataFrame, key: str, size: str, bins: int) -> DataFrame:
    """``items`` with ``bin``; items of one size by ``key``, of equally filled bins the first.

    The distinct sizes, a row each, pass through the driver. Null sizes count as 0 and come last, null keys last of their size.
    """
    sized = items.withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")))
    sizes = [(r["_size"], r["n"]) for r in sized.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()]
    dealt = items.sparkSession.createDataFrame(plan(sorted(sizes, reverse=True), bins), "_s long, _first array<int>, _turn array<int>")
    rows = placed(sized, "_size", [F.asc_nulls_last(key)], "_place", "_row")
    both = rows.join(F.broadcast(dealt), F.col("_size") == F.col("_s"))
    at = F.col("_place") - 1 - F.size("_first")
    bin_ = F.when(at < 0, F.get("_first", (F.col("_place") - 1).cast("int"))).when(F.size("_turn") > 0, F.get("_turn", F.pmod(at, F.greatest(F.size("_turn"), F.lit(1))).cast("int")))
    return both.withColumn("bin", bin_).select(*items.columns, "bin")
