"""Tokens of a text in hand and of a column are the same; BM25 counts them alike in tasks and as rows."""

import random

import pytest
from pyspark.sql import functions as F

from frameseek.functions import tokens
from frameseek.operators import bm25


def texts(seed=1):
    rng = random.Random(seed)
    bits = ["Red", "car", "PHỞ", "bò", "đường", "Đ", "é", "Straße", "a_b", "x9", "42", ",", "!", " ", "  ", "\t", "\n", "-", "²", "日本", " ", "é", "."]
    return ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(30))) for _ in range(200)]


@pytest.mark.parametrize("name", ["EXACT", "FOLDED", "CHARS"])
def test_both_forms_of_a_tokeniser(spark, name):
    t = getattr(tokens, name)
    rows = spark.createDataFrame([(x,) for x in texts()], "t string").select("t", t.column(F.col("t")).alias("w")).collect()
    assert all(r.w == t.text(r.t) for r in rows)


def test_a_large_vocabulary_gives_the_same_scores(spark, monkeypatch):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts(2))] + [(500, None), (501, " "), (502, "!"), (3, "red car again")], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(texts(3)[:20])], "qid long, text string")
    found = lambda: [sorted((r.qid, r.doc_id, round(r.score, 9)) for r in d.collect()) for d in (bm25.scores(docs, asked), bm25.dual_scores(docs, asked))]
    small = found()
    monkeypatch.setattr(bm25, "VOCABULARY_LIMIT", 0)
    assert found() == small and len(small[0]) > 1000
