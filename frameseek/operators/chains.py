"""Chains of frames: gaps filled, heaps spread, strictly rising, and variants around a chain. All as columns.

A chain is an array of frames, one an event, null where none was found; ``lo`` and ``hi`` are the video's first and
last frame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameseek.operators.staging import staged

# Frames closer than this are a heap; the usual length of a chain in seconds.
HEAP, USUAL_SECONDS = 100, 56.6


def _round(x: Column) -> Column:
    """To the nearest whole number, halves to the even one."""
    return F.bround(x, 0).cast("long")


def fill(chain: Column, lo: Column, hi: Column) -> Column:
    """Missing frames between their known neighbours in proportion, outside them on the way to the video's ends; a chain without any stays empty."""
    known = F.filter(F.transform(chain, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"].isNotNull())
    n = F.size(chain)

    def one(x: Column, i: Column) -> Column:
        a = F.try_element_at(F.filter(known, lambda s: s["i"] < i), F.lit(-1))
        b = F.get(F.filter(known, lambda s: s["i"] > i), F.lit(0))
        between = a["x"] + _round((b["x"] - a["x"]) * (i - a["i"]) / (b["i"] - a["i"]))
        after = F.least(hi, a["x"] + _round((hi - a["x"]) * (i - a["i"]) / n))
        before = F.greatest(lo, b["x"] - _round((b["x"] - lo) * (b["i"] - i) / n))
        return F.coalesce(x, F.when(a.isNotNull() & b.isNotNull(), between).when(a.isNotNull(), after).when(b.isNotNull(), before))

    return F.transform(chain, one)


def heaped(chain: Column, how: str) -> Column:
    """Whether a filled chain is a heap: ``total`` looks at its two ends, ``pair`` at any two neighbours, ``never`` at none."""
    if how == "never":
        return F.lit(False)
    if how == "total":
        return F.element_at(chain, -1) - chain[0] < HEAP
    steps = F.zip_with(chain, F.slice(chain, F.lit(2), F.greatest(F.size(chain) - 1, F.lit(0))), lambda a, b: b - a)
    return F.exists(steps, lambda d: F.coalesce(d < HEAP, F.lit(False)))


def spread_wide(n: Column, lo: Column, hi: Column) -> Column:
    """``n`` frames evenly over the video."""
    return F.transform(F.sequence(F.lit(1), n), lambda i: lo + _round((hi - lo) / (n + 1) * i))


def spread_narrow(chain: Column, lo: Column, hi: Column, fps: Column, seconds: float = USUAL_SECONDS) -> Column:
    """As many frames as the chain has places, evenly over the usual length, its first known frame in its place."""
    known = F.filter(F.transform(chain, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"].isNotNull())[0]
    step = F.lit(seconds) * fps / F.greatest(F.size(chain) - 1, F.lit(1))
    return F.transform(chain, lambda x, i: F.greatest(lo, F.least(hi, _round(known["x"] + (i - known["i"]) * step))))


def rising(chain: Column) -> Column:
    """Each frame above the one before it, raised where it is not."""
    low = lambda i: F.array_max(F.transform(F.slice(chain, F.lit(1), i + 1), lambda x, j: x - j))
    return F.transform(chain, lambda x, i: i + low(i))


def finished(chain: Column, lo: Column, hi: Column, how: str = "total", narrow_fps: Column | None = None) -> Column:
    """A found chain as it is answered: filled, spread where it is a heap, rising; null without any frame."""
    whole = fill(chain, lo, hi)
    spread = spread_wide(F.size(chain), lo, hi) if narrow_fps is None else spread_narrow(chain, lo, hi, narrow_fps)
    chosen = F.when((F.size(chain) > 1) & (hi > lo) & heaped(whole, how), spread).otherwise(whole)
    return F.when(F.exists(chain, lambda x: x.isNotNull()), F.transform(rising(chosen), lambda x: x.cast("long")))


def around(chains: DataFrame, key: str, events: int, k: int, shells: int = 40) -> DataFrame:
    """(key, pos, at): a chain and its nearest variants, ``k`` in all; ``chains``: key, at, size.

    ``at`` are the places of a chain's frames among the video's ``size`` frames. Variants shift each place by up to 1,
    then up to 2 and so on; within a shell by the first place's shift, then the next's. They rise strictly and stay
    in the video. A chain that has ``k`` variants is not shifted further.
    """
    open_ = staged(chains.select(key, "at", "size", F.lit(1).cast("long").alias("have")))
    made = [open_.select(key, F.lit(0).cast("long").alias("pos"), "at")]
    for r in range(1, shells):
        open_ = staged(open_.where((F.col("have") < k) & (F.col("size") > r)))
        if open_.isEmpty():
            break
        new = open_.withColumn("new", F.array().cast("array<int>"))
        for e in range(events):
            shift = F.sequence(F.greatest(F.lit(-r), -F.col("at")[e]), F.least(F.lit(r), F.col("size") - 1 - F.col("at")[e]))
            new = new.withColumn(f"o{e}", F.explode(shift)).withColumn("p", (F.col("at")[e] + F.col(f"o{e}")).cast("int"))
            new = new.where(F.col("p") > F.coalesce(F.try_element_at("new", F.lit(-1)), F.lit(-1))).withColumn("new", F.concat("new", F.array("p")))
        shell = new.where(F.greatest(*[F.abs(f"o{e}") for e in range(events)], F.lit(0)) == r)
        place = F.row_number().over(Window.partitionBy(key).orderBy(*[f"o{e}" for e in range(events)]))
        some = staged(shell.withColumn("pos", F.col("have") + place - 1).where(F.col("pos") < k).select(key, "pos", F.col("new").alias("at")))
        made.append(some)
        more = some.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("more"))
        open_ = open_.join(more, F.col(key) == F.col("_k"), "left").select(key, "at", "size", (F.col("have") + F.coalesce("more", F.lit(0).cast("long"))).alias("have"))
    return reduce(DataFrame.union, made)
