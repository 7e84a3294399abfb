"""Grading: recall at cut-offs, tolerance windows, chain scores, paired comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTS = (1, 5, 20, 50, 100)


def question_score(rank: Column) -> Column:
    """Mean over the cut-offs of [rank <= cut]; no rank scores 0."""
    return sum((F.coalesce((rank <= c).cast("int"), F.lit(0)) for c in CUTS[1:]), F.coalesce((rank <= CUTS[0]).cast("int"), F.lit(0))) / len(CUTS)


def first_hit(ranked: DataFrame, gold: DataFrame, on: list[str]) -> DataFrame:
    """(qid, rank): first correct rank of every question with gold, null where none is found."""
    hits = ranked.join(gold.select("qid", *on).distinct(), ["qid", *on], "left_semi").groupBy("qid").agg(F.min("rank").alias("rank"))
    return gold.select("qid").distinct().join(hits, "qid", "left")


def paired(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Mean difference, wins, losses, ties and two standard errors of columns a and b."""
    d = F.col(a) - F.col(b)
    se2 = 2 * F.coalesce(F.stddev_samp(d), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))
    return scores.agg(F.round(F.avg(d), 6).alias("mean"), F.count_if(d > 0).alias("win"), F.count_if(d < 0).alias("loss"), F.count_if(d == 0).alias("tie"), F.round(se2, 6).alias("se2"))
