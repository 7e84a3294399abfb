"""Ranked lists: top-k, caps per group, rank fusion, score normalisation.

A ranked list is (qid, row_id, video_id, score, rank); order is always explicit, ties
go to the smaller row_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rank(df: DataFrame, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top(df: DataFrame, k: int, by: list[str] | None = None, score: str = "score", key: str = "row_id") -> DataFrame:
    """The k best of each group, ranked; Spark cuts each partition to k before it shuffles."""
    return rank(df, by or ["qid"], F.desc(score), F.col(key)).where(F.col("rank") <= k)


def cap(df: DataFrame, per_video: int, k: int | None = None) -> DataFrame:
    """At most ``per_video`` rows of a video in rank order, then k, re-ranked."""
    kept = rank(df, ["qid", "video_id"], F.col("rank"), name="_in").where(F.col("_in") <= per_video).drop("_in")
    kept = rank(kept, ["qid"], F.col("rank"), name="rank")
    return kept.where(F.col("rank") <= k) if k else kept


def rrf(lists: list[DataFrame], weights: list[float] | None = None, k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion; a row keeps the first list's payload, ties go by first list, then rank."""
    weights = weights or [1.0] * len(lists)
    if len(weights) != len(lists):
        raise ValueError("one weight a list")
    tagged = [d.select("qid", "row_id", "video_id", F.lit(i).alias("list"), "rank", (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("part")) for i, (d, w) in enumerate(zip(lists, weights))]
    every = reduce(DataFrame.unionByName, tagged)
    seen = F.min(F.struct("list", "rank", "video_id"))
    fused = every.groupBy("qid", "row_id").agg(F.sum("part").alias("raw"), seen.alias("first"), F.array_sort(F.collect_list(F.struct("list", "rank"))).alias("src"))
    fused = fused.select("qid", "row_id", F.col("first.video_id").alias("video_id"), F.round("raw", 9).alias("score"), "first", F.array_join(F.transform("src", lambda s: F.concat_ws("@", s["list"], s["rank"])), ",").alias("sources"))
    return rank(fused, ["qid"], F.desc("score"), F.col("first.list"), F.col("first.rank"), F.col("row_id")).drop("first")


def video_order(df: DataFrame) -> DataFrame:
    """(qid, video_id, video_rank): videos by first appearance."""
    return rank(df.groupBy("qid", "video_id").agg(F.min("rank").alias("first")), ["qid"], F.col("first"), name="video_rank").drop("first")


def two_stage_rrf(lists: list[DataFrame], per_video: int, k: int) -> DataFrame:
    """RRF over videos by first appearance, then over ranks within a video; the score is the sum."""
    videos = rrf([video_order(d).select("qid", F.col("video_id").alias("row_id"), "video_id", F.col("video_rank").alias("rank")) for d in lists]).select("qid", "video_id", F.col("score").alias("v"))
    inner = rrf([rank(d, ["qid", "video_id"], F.col("rank"), name="r2").select("qid", "row_id", "video_id", F.col("r2").alias("rank")) for d in lists]).select("qid", "row_id", "video_id", F.col("score").alias("s"))
    both = inner.join(videos, ["qid", "video_id"]).select("qid", "row_id", "video_id", F.round(F.col("v") + F.col("s"), 9).alias("score"))
    both = rank(both, ["qid", "video_id"], F.desc("score"), F.col("row_id"), name="_in").where(F.col("_in") <= per_video)
    return top(both.drop("_in"), k)


def normalise(df: DataFrame, how: str, tau: float = 1.0, by: tuple[str, ...] = ("qid",), log: bool = False) -> DataFrame:
    """Adds ``norm``: z (population), minmax or sigmoid(tau * z) of score; a constant list gives 0, 0 and 0.5.

    With ``log`` of ln(1 + score) instead, scores below 0 as 0.
    """
    w, score = Window.partitionBy(*by), F.log1p(F.greatest("score", F.lit(0.0))) if log else F.col("score")
    sd, mean, lo, hi = F.stddev_pop(score).over(w), F.avg(score).over(w), F.min(score).over(w), F.max(score).over(w)
    z = F.when(lo == hi, 0.0).otherwise((score - mean) / sd)
    if how == "z":
        return df.withColumn("norm", z)
    if how == "minmax":
        return df.withColumn("norm", F.when(lo == hi, 0.0).otherwise((score - lo) / (hi - lo)))
    x = F.greatest(F.least(tau * z, F.lit(60.0)), F.lit(-60.0))
    return df.withColumn("norm", 1.0 / (1.0 + F.exp(-x)))


def score_fusion(lists: list[DataFrame], weights: list[float], how: str = "minmax", fill: str = "min") -> DataFrame:
    """Sum of weighted normalised scores; a row that a list lacks gets that list's least norm, or 0."""
    normed = [normalise(d, how).select("qid", "row_id", "norm") for d in lists]
    grid = reduce(DataFrame.union, [d.select("qid", "row_id") for d in normed]).distinct()
    out = grid.withColumn("raw", F.lit(0.0))
    for d, w in zip(normed, weights):
        least = d.groupBy("qid").agg(F.min("norm").alias("least"))
        out = out.join(d, ["qid", "row_id"], "left").join(least, "qid", "left")
        gap = F.coalesce("least", F.lit(0.0)) if fill == "min" else F.lit(0.0)
        out = out.select("qid", "row_id", (F.col("raw") + w * F.coalesce("norm", gap)).alias("raw"))
    return out.select("qid", "row_id", F.round("raw", 6).alias("score"))


def rerank(df: DataFrame, head: int, how: str, weight: float = 1.0) -> DataFrame:
    """A ranked list with ``ext``, an external score or null, re-ranked in place: of the first ``head`` rows those that
    have one trade places among themselves, all others keep theirs.

    ``replace`` orders them by the external score, ``rrf`` by reciprocal ranks of both orders, ``multiply`` by the
    score times 1 + weight * the external score (0 to 1 within the question; 0.5 where all are equal), and ``lift`` likewise by
    what of that is above its middle. Equal ones keep their order.
    """
    w = Window.partitionBy("qid")
    scored = df.where((F.col("rank") <= head) & F.col("ext").isNotNull())
    if how == "replace":
        key = F.col("ext")
    elif how == "rrf":
        scored = rank(scored, ["qid"], F.desc("ext"), F.col("rank"), name="_h")
        key = 1.0 / (RRF_K + F.col("rank")) + weight / (RRF_K + F.col("_h"))
    elif how in ("multiply", "lift"):
        lo, hi = F.min("ext").over(w), F.max("ext").over(w)
        unit = F.when(hi - lo < 1e-9, 0.5).otherwise((F.col("ext") - lo) / (hi - lo))
        key = F.col("score") * (1.0 + weight * (unit if how == "multiply" else F.greatest(unit - 0.5, F.lit(0.0)) * 2))
    else:
        raise ValueError(f"no way to rerank: {how!r}")
    scored = scored.withColumn("_key", F.round(key, 9))
    by_key = rank(scored, ["qid"], F.desc("_key"), F.col("rank"), name="_o").select(*[c for c in df.columns if c != "rank"], "_o")
    places = rank(scored, ["qid"], F.col("rank"), name="_o").select("qid", "_o", "rank")
    kept = df.where((F.col("rank") > head) | F.col("ext").isNull())
    return by_key.join(places, ["qid", "_o"]).select(*df.columns).union(kept)
