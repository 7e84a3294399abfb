"""Greedy suppression against the sequential rule."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameseek.operators import greedy


def sequential(rows, near, keep):
    out, kept = set(), {}
    for g, s, i, v in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2])):
        if v is None or any(x is None or not np.isfinite(x) for x in v):
            out.add((g, i))
            continue
        if sum(bool(near(np.array([v]), np.array([u]))[0, 0]) for u in kept.get(g, [])) < keep:
            kept.setdefault(g, []).append(v)
            out.add((g, i))
    return out


def unit(rng):
    v = np.array([rng.gauss(0, 1) for _ in range(3)])
    return (v / np.linalg.norm(v)).tolist()


NEAR = {"cosine": greedy.cosine(0.8), "closer": greedy.closer(2.0), "overlap": greedy.overlap(0.3)}


@pytest.mark.parametrize("kind", NEAR)
@pytest.mark.parametrize("keep,block,share", [(1, 2048, 32768), (2, 12, 20)])
def test_rounds_equal_the_sequential_rule(spark, monkeypatch, kind, keep, block, share):
    monkeypatch.setattr(greedy, "SHARE", share)
    rng = random.Random(keep * 100 + block)
    value = {"cosine": lambda: unit(rng), "closer": lambda: [rng.randrange(60) / 2], "overlap": lambda: (lambda y, x: [y, x, y + rng.randint(0, 4), x + rng.randint(1, 4)])(rng.randrange(5), rng.randrange(5))}[kind]
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(20)]), i, [float(x) for x in value()]) for i in range(90)]
    rows += [("a", 50, 1000, None), ("b", 50, 1001, [float("nan")] * len(rows[0][3])), ("b", 50, 1002, [None] * len(rows[0][3])), ("c", 1, 1003, rows[0][3])]
    df = spark.createDataFrame([(g, None if s is None else float(s), i, v, "x", 1) for g, s, i, v in rows], "g string, score double, row_id long, v array<double>, i string, n int")
    got = greedy.suppress(df, ["g"], "score", "row_id", F.col("v"), NEAR[kind], keep, block)
    assert got.columns == df.columns
    assert {(r.g, r.row_id) for r in got.collect()} == sequential(rows, NEAR[kind], keep)


def test_a_hot_group_of_copies_leaves_in_one_round(spark, monkeypatch):
    made = []
    monkeypatch.setattr(greedy, "staged", lambda df: made.append(df) or df.cache())
    df = spark.range(3000).select(F.lit("a").alias("g"), F.col("id").alias("row_id"), (-F.col("id")).cast("double").alias("score"), F.array(F.lit(1.0), F.lit(0.0)).alias("v"))
    assert [r.row_id for r in greedy.suppress(df, ["g"], "score", "row_id", F.col("v"), greedy.cosine(0.99), block=100).collect()] == [0]
    assert len(made) == 4  # the rows, one round's decisions, its chunks, and none left


def test_empty_tables_and_values_of_several_lengths(spark):
    df = spark.createDataFrame([("a", 1.0, 1, [1.0]), ("a", 1.0, 2, [1.0, 2.0])], "g string, score double, row_id long, v array<double>")
    assert greedy.suppress(df.limit(0), ["g"], "score", "row_id", F.col("v"), greedy.closer(1.0)).count() == 0
    with pytest.raises(ValueError):
        greedy.suppress(df, ["g"], "score", "row_id", F.col("v"), greedy.closer(1.0))
