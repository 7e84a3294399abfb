"""Small fixtures for the operators; each result is worked out by hand or by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameseek.operators import bm25, dense
from frameseek.operators import sequences as sq


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


LIST = "qid string, row_id long, video_id long, score double, rank int"


def test_tokens_do_not_cross_punctuation(spark):
    from pyspark.sql import functions as F

    from frameseek.functions import text as tx

    got = frame(spark, [("Red car, blue sky!",)], "t string").select(tx.tokens(F.col("t"))).first()[0]
    assert got == ["red", "car", "blue", "sky", "red_car", "blue_sky"]


def test_folds_differ_on_the_stroked_d(spark):
    from pyspark.sql import functions as F

    from frameseek.functions import text as tx

    row = frame(spark, [(" Đường Phố é",)], "t string").select(tx.fold_full(F.col("t")), tx.fold_marks(F.trim("t"))).first()
    assert tuple(row) == ("duong pho e", "đuong pho e")


def test_bm25_blank_documents_and_common_tokens(spark):
    from frameseek.operators import bm25

    docs = frame(spark, [(1, "a b"), (2, "a c"), (3, "   "), (4, "a d")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in bm25.scores(docs, frame(spark, [(1, "a b b")], "qid long, text string")).collect()}
    assert set(got) == {1, 2, 4} and min(got.values()) > 0 and got[1] > got[2]


def test_dual_index_prefers_exact_accents(spark):
    from frameseek.operators import bm25

    docs = frame(spark, [(1, "phở bò"), (2, "pho bo"), (3, "khác")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in bm25.dual_scores(docs, frame(spark, [(1, "phở")], "qid long, text string")).collect()}
    assert set(got) == {1, 2} and got[1] > got[2]


def test_rrf_agreement_and_weights(spark):
    from frameseek.operators import ranking

    a = frame(spark, [("q", 1, 1, 9.0, 1), ("q", 2, 1, 8.0, 2)], LIST)
    b = frame(spark, [("q", 2, 1, 5.0, 1), ("q", 3, 1, 4.0, 2)], LIST)
    got = [(r.row_id, r.sources) for r in ranking.rrf([a, b]).orderBy("rank").collect()]
    assert got == [(2, "0@2,1@1"), (1, "0@1"), (3, "1@2")]
    with pytest.raises(ValueError):
        ranking.rrf([a, b], [1.0])


def test_normalise_constant_list(spark):
    from frameseek.operators import ranking

    d = frame(spark, [("q", 1, 1, 2.0, 1), ("q", 2, 1, 2.0, 2)], LIST)
    assert {how: {r.norm for r in ranking.normalise(d, how).collect()} for how in ("z", "minmax", "sigmoid")} == {"z": {0.0}, "minmax": {0.0}, "sigmoid": {0.5}}


def test_question_score_cutoffs(spark):
    from pyspark.sql import functions as F

    from frameseek.operators.evaluate import question_score

    d = frame(spark, [(r,) for r in (1, 5, 20, 50, 100, 101, None)], "r int")
    assert [x[0] for x in d.select(question_score(F.col("r"))).collect()] == [1.0, 0.8, 0.6, 0.4, 0.2, 0.0, 0.0]


def test_dense_top_k_ties_by_id(spark):
    from frameseek.operators import dense

    v = frame(spark, [(i, [1.0, 0.0]) for i in (5, 3, 9)] + [(1, [0.0, 1.0])], "row_id long, v array<float>")
    got = dense.top_k(v, frame(spark, [(7, [1.0, 0.0])], "qid long, v array<float>"), 2).orderBy("rank").collect()
    assert [r.row_id for r in got] == [3, 5]


def test_vectors_of_several_lengths_are_an_error_and_null_components_match_none(spark):
    asked = frame(spark, [(7, [1.0, 0.0])], "qid long, v array<float>")
    for bad in ([(1, [1.0]), (2, [2.0, 3.0, 4.0])], [(1, [1.0, 2.0, 3.0])]):
        with pytest.raises(Exception, match="components"):
            dense.top_k(frame(spark, bad, "row_id long, v array<float>"), asked, 2).collect()
    rows = frame(spark, [(1, [None, 1.0]), (2, [0.5, 9.0]), (3, [float("nan"), 1.0]), (4, None), (5, [0.25, None])], "row_id long, v array<float>")
    assert [(r.row_id, r.score) for r in dense.top_k(rows, asked, 5).collect()] == [(2, 0.5)]


def test_beam_needs_rising_times():
    assert sq.beam([[(2, 20.0, 1.0)], [(0, 0.0, 1.0)]]) == []
    assert [c for c, _ in sq.beam([[(0, 0.0, 1.0)], [(2, 20.0, 1.0)]])] == [[0, 2]]


def test_beam_diversity():
    events = [[(0, 0.0, 1.0), (1, 0.1, 0.9)], [(2, 50.0, 1.0)]]
    assert len(sq.beam(events, spacing=3.0)) == 1 and len(sq.beam(events, spacing=0.05)) == 2


def test_packing_and_unions():
    assert sq.quota_union([[1, 2, 3], [2, 4]], [2, 2], 4) == [1, 2, 4, 3]


def test_text_splitters_and_numbers():
    assert sq.split_events("Night market\nE1: a man\nE2: a dog") == ["Night market a man", "Night market a dog"]
    long = " ".join(["w"] * 30) + ". " + " ".join(["v"] * 30) + "."
    assert [len(c.split()) for c in sq.split_clauses(long)] == [30, 30]



def test_file_sources(spark, tmp_path):
    from frameseek.sources import files

    (tmp_path / "L01_V001.mp4").write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "L01_V001.csv").write_bytes(b"x")
    row = files.discover(spark, f"file://{tmp_path}").first()
    assert row["video_id"] == "L01_V001" and row["video"] and row["csv"] and row["clip"] is None
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "query-p1-1-kis.txt").write_text("a\nb")
    (tmp_path / "q" / "other.txt").write_text("c")
    assert [tuple(r) for r in files.query_folder(spark, f"file://{tmp_path}/q").collect()] == [("query-p1-1-kis.txt", "kis", "a\nb")]
    (tmp_path / "log").write_text('{"row_id": 1, "caption": "old"}\n{"row_id": 1, "caption": "new"}\n{"row_id": 2, "ca\n')
    assert [tuple(r) for r in files.compact_log(spark, f"file://{tmp_path}/log", "row_id", "caption").collect()] == [(1, "new")]


def test_sessions_on_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from frameseek.streaming.sessions import sessions, stream_events

    rows = frame(spark, [(1, 0), (1, 5), (1, 100), (2, 0), (9, 10_000)], "video_id long, s long").select("video_id", (F.col("s") * 1_000_000).alias("us"), F.timestamp_seconds("s").alias("at"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = sessions(stream_events(spark, f"{tmp_path}/in", rows.schema), "10 seconds", "1 second").select("video_id", "first_us", "n")
    q = out.writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from sess").collect())) == [(1, 0, 2), (1, 100_000_000, 1), (2, 0, 1)]


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 150


@pytest.mark.parametrize("key", [None, "label"])
def test_dense_top_k_in_many_blocks_is_brute_force(spark, monkeypatch, key):
    monkeypatch.setattr(dense, "ROW_BLOCK", 7)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 3).astype(float).tolist(), i % 3) for i in range(60)]
    whole = frame(spark, rows + [(90, None, 0), (91, [None, 1.0, 1.0], 0)], "row_id long, v array<float>, label int")
    asked = whole.where("row_id % 4 = 0").withColumnRenamed("row_id", "qid")
    got = {(r.qid, r["rank"]): (r.row_id, r.score) for r in dense.top_k(whole, asked, 5, exclude_same=key).collect()}
    want = {}
    for q, x, own in rows[::4]:
        s = sorted((-float(np.dot(x, v)), i) for i, v, label in rows if not key or label != own)
        want |= {(q, n + 1): (i, -score) for n, (score, i) in enumerate(s[:5])}
    assert got == want


def test_dense_blocks_within_a_group_and_without_rows(spark, monkeypatch):
    monkeypatch.setattr(dense, "ROW_BLOCK", 2)
    v = frame(spark, [(i, [float(i)], "a" if i < 5 else "b" if i < 7 else None) for i in range(8)], "row_id long, v array<float>, g string")
    sums = lambda r, q, s: [r["row_id"], s.sum(axis=1)]
    met = dense.tiles(v, v.withColumnRenamed("row_id", "qid"), sums, "row_id long, s double", within="g")
    assert {r.row_id: r.s for r in met.groupBy("row_id").agg(F.sum("s").alias("s")).collect()} == {i: i * (10.0 if i < 5 else 11.0) for i in range(7)}
    assert dense.tiles(v.limit(0), v.withColumnRenamed("row_id", "qid"), sums, "row_id long, s double").count() == 0


def test_rounding_takes_halves_away_from_zero():
    assert dense.rounded(np.array([0.125, -0.125, 2.5, -np.inf]), 2).tolist() == [0.13, -0.13, 2.5, -np.inf]


def test_bm25_over_sizes_of_the_asked_vocabulary(spark, monkeypatch):
    docs = frame(spark, [(1, "a b b"), (2, "b c"), (3, "  "), (4, "?!"), (5, None), (6, "c c c d")], "doc_id long, text string")
    asked = frame(spark, [(1, "b c"), (2, "z"), (3, ""), (4, "b b")], "qid long, text string")
    broadcast = {(r.qid, r.doc_id): r.score for r in bm25.scores(docs, asked).collect()}
    monkeypatch.setattr(bm25, "VOCABULARY_LIMIT", 0)
    shuffled = {(r.qid, r.doc_id): r.score for r in bm25.scores(docs, asked).collect()}
    texts = {1: ["a", "b", "b", "a_b", "b_b"], 2: ["b", "c", "b_c"], 4: [], 6: ["c", "c", "c", "d", "c_c", "c_c", "c_d"]}
    mean = sum(map(len, texts.values())) / len(texts)

    def score(words):
        out = {}
        for t in words:
            df = sum(t in x for x in texts.values())
            for i, x in texts.items():
                tf = x.count(t)
                if tf:
                    out[i] = out.get(i, 0) + np.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(x) / mean))
        return out

    want = {(q, i): s for q, words in {1: ["b", "c", "b_c"], 4: ["b", "b_b"]}.items() for i, s in score(words).items()}
    assert broadcast == pytest.approx(want) and shuffled == pytest.approx(want)


@pytest.mark.parametrize("how", ["replace", "rrf", "multiply", "lift"])
def test_reranking_in_place(spark, how):
    from frameseek.operators import ranking

    # Rows 0 to 11 by rank; the first five and one beyond the head have an external score, reversed.
    ext = {0: 0.1, 1: 0.2, 2: 0.3, 3: 0.4, 4: 0.5, 11: 9.0}
    rows = frame(spark, [("q", i, 12.0 - i, i + 1, ext.get(i)) for i in range(12)] + [("r", 1, 5.0, 1, None), ("r", 2, 4.0, 2, 0.7), ("s", 1, 5.0, 1, 0.5), ("s", 2, 4.0, 2, 0.5)], "qid string, row_id long, score double, rank int, ext double")
    got = {}
    for r in ranking.rerank(rows, 6, how, 3.0).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.row_id
    order = [got["q"][i] for i in range(1, 13)]
    unit = {i: (ext[i] - 0.1) / 0.4 for i in range(5)}
    key = {"replace": lambda i: ext[i], "rrf": lambda i: 1 / (61 + i) + 3 / (65 - i), "multiply": lambda i: (12 - i) * (1 + 3 * unit[i]), "lift": lambda i: (12 - i) * (1 + 3 * max(unit[i] - 0.5, 0) * 2)}[how]
    assert order[:5] == sorted(range(5), key=lambda i: (-round(key(i), 9), i)) and order[5:] == list(range(5, 12))
    assert got["r"] == {1: 1, 2: 2} and got["s"] == {1: 1, 2: 2}
    with pytest.raises(ValueError):
        ranking.rerank(rows, 6, "other")
