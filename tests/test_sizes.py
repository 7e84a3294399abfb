"""Operators that must not make a row a pair, or a row a position, against their plain forms."""

import os
import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frameseek.functions.tokens import CHARS, EXACT, FOLDED
from frameseek.operators import accents, bm25, chunks, hierarchy, phrase_blocks, ranking
from frameseek.plans import phrases
from frameseek.sources import blobs, files, storage


def said(rng, n):
    return " ".join(rng.choice(["phở", "pho", "bò", "bo", "a", "b", "c", "Đò", "xe. x"]) for _ in range(n))


def ranked(df):
    return sorted((r.qid, r.rank, r.doc_id, round(r.score, 6)) for r in df.collect())


def plain(scores, k):
    return ranked(ranking.top(scores.withColumn("score", F.round("score", 6)), k, key="doc_id"))


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_same_texts_are_scored_once(spark, monkeypatch, limit):
    monkeypatch.setattr(bm25, "ASKED_LIMIT", limit)
    rng = random.Random(4)
    names = [said(rng, n) for n in (1, 2, 2, 3, 4, 5)] + [" ", None]
    docs = spark.createDataFrame([(i, rng.choice(names)) for i in range(200)], "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(i, rng.choice(names)) for i in range(30)], "qid long, text string")
    got = bm25.top_k_of_texts(docs, asked, 5, [CHARS], [1.0])
    assert ranked(got) == plain(bm25.scores(docs, asked, CHARS), 5)
    # However many documents have a text, at most k of them and one row a text are scored.
    texts = docs.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    assert bm25.top_k(texts, asked.limit(1), 5, [CHARS], [1.0]).count() <= 6


def test_only_the_best_of_a_task_leave_it(spark, monkeypatch):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, said(rng, rng.randrange(0, 12))) for i in range(300)] + [(500, None)], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, said(rng, rng.randrange(0, 6))) for i in range(20)] + [(50, None)], "qid long, text string")
    want = plain(bm25.dual_scores(docs, asked), 7)
    for pairs in (2_000_000, 64):  # all documents at once, and a few
        monkeypatch.setattr(bm25, "PAIRS", pairs)
        rows = bm25.top_k(docs, asked, 7, [EXACT, FOLDED], [0.5, 0.5])
        assert ranked(ranking.top(rows, 7, key="doc_id")) == want
        assert rows.count() <= 7 * 20 * rows.rdd.getNumPartitions() < bm25.dual_scores(docs, asked).count()
    none = docs.where("doc_id < 0")
    assert bm25.top_k(none, asked, 7, [EXACT], [1.0]).count() == 0 == bm25.top_k(docs, asked.where("qid < 0"), 7, [EXACT], [1.0]).count()


def test_a_phrase_leaves_a_task_once(spark):
    """The dictionary's shuffle has a row a distinct phrase and task, however often it occurs."""
    docs = spark.createDataFrame([(i, "Phở bò. phở bò, và phở BÒ ngon é") for i in range(400)] + [(None, "Phở"), (900, None), (901, "plain")], "doc_id long, text string").repartition(2)
    book = accents.dictionary(docs)
    book.write.format("noop").mode("overwrite").save()
    plan = book._jdf.queryExecution().toString()
    assert "Generate" not in plan  # no row a position
    rows = {r.folded: r.accented for r in book.collect()}
    assert rows["pho"] == "Phở" and rows["pho bo"] == "Phở bò" and "plain" not in rows and "e" not in rows
    keyed = accents.dictionary(docs.select(F.struct("doc_id").alias("doc_id"), "text"))
    assert keyed.count() == len(rows)


def test_restoring_joins_the_dictionary_once(spark):
    docs = spark.createDataFrame([(1, "Phở bò ngon"), (2, "bọ ngòn và")], "doc_id long, text string")
    texts = spark.createDataFrame([(1, "pho bo ngon, VA bo"), (1, "x"), (2, None), (3, "")], "doc_id long, text string")
    done = accents.restore(texts, accents.dictionary(docs))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # no rounds over rows a position
    assert sorted(repr(r.restored) for r in done.collect()) == ["''", "'Phở bò ngon, và bò'", "'x'", "None"]


@pytest.mark.parametrize("chars", [4_000_000, 40])
def test_only_phrases_that_are_asked_for_leave_the_dictionary(spark, monkeypatch, chars):
    monkeypatch.setattr(phrase_blocks, "BLOCK_CHARS", chars)
    rng = random.Random(7)
    vocabulary = ["Phở", "phò", "bò", "BÓ", "bo", "ngon", "đò", "Đô", "x", "é", "İstanbul", "ΣΌΦΟΣ"]
    say = lambda n, sep=" ": sep.join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, f"{say(rng.randrange(0, 9))}, phở số {i} chỉ ở {'ạbcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}") for i in range(100)] + [(None, "Tà lùng"), (200, None), (201, ""), (202, "plain"), (203, "tá lung")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = [(i, phrases.tx.bare(say(rng.randrange(0, 20), rng.choice([" ", ", "])))) for i in range(50)] + [(60, None), (61, ""), (62, "đã có dấu pho"), (63, "TA LUNG, pho"), (63, "bo")]
    texts = spark.createDataFrame(asked, "doc_id long, text string").repartition(2)
    book = accents.dictionary(docs)
    want = sorted(map(repr, accents.restore(texts, book).collect()))
    for key in ("doc_id", F.struct(F.col("doc_id").isNull(), "doc_id").alias("doc_id")):
        got = accents.restore_from(texts, docs.select(key, "text"))
        assert sorted(map(repr, got.collect())) == want
    have, want_ = phrase_blocks.shared(phrase_blocks.blocks(accents._folded(docs, "doc_id", "text")), phrase_blocks.blocks(accents._numbered(texts, "doc_id", "text")[1]), 4)
    rows = phrase_blocks.first_phrases(have, 4, docs.schema["doc_id"].dataType, True)
    ask = {" ".join(w[a : a + n]) for _, t in asked if t and t == phrases.tx.bare(t) or t == "TA LUNG, pho" for w in [re.findall(r"[^\W\d_]+", t.lower())] for a in range(len(w)) for n in range(1, 5)}
    assert {r.folded for r in rows.collect()} == {r.folded for r in book.collect()} & ask
    assert rows.select("folded").distinct().count() < book.count() / 2
    # The query does not make the whole dictionary either.
    monkeypatch.setattr(accents, "dictionary", lambda *a, **k: 1 / 0)
    talk = texts.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), "text")
    assert phrases.restored_accents(SimpleNamespace(conversations=talk, documents=docs)).count() == len(asked) - 1


def test_of_equal_phrases_the_first_by_id_and_place(spark):
    """Also where two texts have one id; and hash values come back as they were."""
    docs = spark.createDataFrame([(5, "x bo BÓ"), (5, "Bò"), (9, "bô"), (None, "bố đồ"), (7, "ĐÔ")], "doc_id long, text string").coalesce(1)
    texts = spark.createDataFrame([(1, "bo"), (2, "đo?"), (3, "bo, đo")], "doc_id long, text string")
    assert sorted(tuple(r) for r in accents.restore_from(texts, docs).collect()) == [(1, "Bò"), (2, "ĐÔ?"), (3, "bố, đồ")]
    values = np.unique(np.random.default_rng(3).integers(0, 1 << phrase_blocks.BITS, 5000, dtype=np.uint64))
    for some in (values, values[:1], values[:0], np.array([0, 1, (1 << phrase_blocks.BITS) - 1], np.uint64)):
        assert (phrase_blocks._decoded(phrase_blocks._coded(some)) == some).all()


def test_words_meet_their_counts_by_block(spark):
    """A row a block and word, not a position, and the blocks' size changes no chunk."""
    docs = spark.createDataFrame([(i % 30, f"a bb ccc {i % 7} dddddddd\x0b " * 20) for i in range(100)] + [(7, None), (8, " ")], "doc_id int, text string").repartition(3)
    got = []
    for size in (4_000_000, 500):
        chunks.BLOCK_CHARS = size
        done = chunks.pack(docs, 9)
        assert "posexplode" not in done._jdf.queryExecution().toString()
        got.append(sorted(map(tuple, done.collect())))
    chunks.BLOCK_CHARS = 4_000_000
    assert got[0] == got[1] and sum(len(r[4].split()) for r in got[0]) == 100 * 100


def test_a_closure_writes_a_pair_once(spark, monkeypatch):
    rows, write = [], hierarchy.written
    monkeypatch.setattr(hierarchy, "written", lambda df: rows.append((out := write(df)).count()) or out)
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(6, 0)], "child int, parent int")
    got = hierarchy.closure(spark.createDataFrame([(0,), (3,)], "seed int"), edges)
    assert got.count() == 14 and sum(rows) == 7 + 14
    monkeypatch.setattr(hierarchy, "ROUNDS", 2)
    assert sorted(hierarchy.closure(spark.createDataFrame([(0,), (3,)], "seed int"), edges).collect()) == sorted(got.collect())


def test_phrases_meet_texts_in_one_join(spark):
    texts = spark.createDataFrame([(1, ["a", "b", "c", "a", "b"]), (2, [])], "qid int, words array<string>")
    found = hierarchy.matches(texts, spark.createDataFrame([("a b",), ("b c a",), ("c",), ("a b c a b",), (None,)], "phrase string"))
    assert found._jdf.queryExecution().analyzed().toString().count("Join") == 1
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, 1, "a b"), (1, 1, 3, "b c a"), (1, 2, 2, "c"), (1, 3, 4, "a b")]


def test_names_of_files_stay_in_tasks(spark, tmp_path, monkeypatch):
    """The driver neither lists nor moves the files; numbers of five digits are videos of their own."""
    root = f"file://{tmp_path}/tree"
    names = [f"{k}/L01_V{n}{e}" for n in ("001", "9999", "10000", "10001") for k, e in (("csv", ".csv"), ("keyframes", "/001.jpg"), ("keyframes", "/a/_b.jpg"))]
    rows = spark.createDataFrame([(n.replace("_b", "b"),) for n in names], "path string").selectExpr("path", "'x' as content").repartition(3)
    monkeypatch.setattr(storage, "settle", lambda *a: 1 / 0)  # the driver's own; tasks have the module's
    blobs.write(rows, root)
    monkeypatch.setattr(storage, "files", lambda *a: 1 / 0)
    (tmp_path / "tree" / "_x").mkdir()
    (tmp_path / "tree" / "_x" / "L09_V001.csv").write_text("x")
    (tmp_path / "tree" / ".L08_V001.csv").write_text("x")
    listed, tables = files.listed(spark, root)
    assert "binaryFile" not in listed._jdf.queryExecution().toString() and len(tables) == 4
    assert sorted(r.path for r in listed.collect()) == sorted(f"file:{tmp_path}/tree/{n}".replace("_b", "b") for n in names)
    got = files._listing(root, 1)(iter([pa.RecordBatch.from_pydict({"path": [f"{tmp_path}/tree/csv", f"{tmp_path}/tree/keyframes"]})]))
    assert [b.num_rows for b in got] == [1] * 8
    found = files.discover(spark, root)
    assert sorted(r.video_id for r in found.collect()) == ["L01_V001", "L01_V10000", "L01_V10001", "L01_V9999"]
    assert found.where("csv is null or keyframe_dir is null").count() == 0


def test_a_failed_move_takes_the_others_back(spark, tmp_path):
    (tmp_path / "in the way.txt" / "x").mkdir(parents=True)
    rows = spark.createDataFrame([(f"{i}.txt", "x") for i in range(20)] + [("in the way.txt", "x")], "path string, content string").repartition(4)
    with pytest.raises(Exception):
        blobs.write(rows, f"file://{tmp_path}")
    assert [f for f in os.listdir(tmp_path) if f[0] != "_"] == ["in the way.txt"]
