"""Channels: dense search and its variants, BM25, label matching, rare-token filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameseek.functions import text as tx
from frameseek.functions.tokens import CHARS, EXACT, FOLDED
from frameseek.operators import bm25, dense, greedy, ranking
from frameseek.operators.staging import staged
from frameseek.plans.registry import FRAMES, Tables, query

DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
QV = "q AS (SELECT vec_id AS qid, embedding, label FROM embeddings WHERE vec_id % 20 = 0)"


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v"), "label")


def _asked(t: Tables) -> DataFrame:
    """A query set of the table: ids divisible by 20."""
    return _vectors(t).where("row_id % 20 = 0").withColumnRenamed("row_id", "qid")


def _top_sql(score: str, where: str = "true", k: int = 10) -> str:
    return f"WITH {QV}, s AS (SELECT b.qid, a.vec_id AS row_id, round({score}, 6) AS score FROM embeddings a, q b WHERE {where}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM s) SELECT qid, row_id, score, rank FROM r WHERE rank <= {k}"


@query("V1_W1_dense_topk", _top_sql(DOT))
def dense_topk(t: Tables) -> DataFrame:
    return dense.top_k(_vectors(t), _asked(t), 10)


@query("V2_dense_channel_cap", f"WITH {QV}, s AS (SELECT b.qid, a.vec_id AS row_id, a.label AS video_id, round({DOT}, 6) AS score FROM embeddings a, q b), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM s), p AS (SELECT * FROM r WHERE rank <= 300), c AS (SELECT *, row_number() OVER (PARTITION BY qid, video_id ORDER BY rank) AS n FROM p), f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS pos FROM c WHERE n <= 5) SELECT qid, row_id, video_id, score, CAST(pos AS INTEGER) AS rank FROM f WHERE pos <= 50")
def dense_channel(t: Tables) -> DataFrame:
    """The pool is cut to k * per_video + 200 before the cap, so fewer than k rows can return."""
    k, per_video = 20, 5
    pool = dense.top_k(_vectors(t), _asked(t), k * per_video + 200)
    pool = pool.join(_vectors(t).select("row_id", F.col("label").alias("video_id")), "row_id")
    return ranking.cap(pool.select("qid", "row_id", "video_id", "score", "rank"), per_video, 50)


POOL = f"""{QV}, s AS (SELECT b.qid, a.vec_id AS row_id, a.label AS video_id, CAST(a.embedding AS DOUBLE[]) AS v, round({DOT}, 6) AS score FROM embeddings a, q b), pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM s) WHERE rank <= 100),
o AS (SELECT *, row_number() OVER (PARTITION BY qid, video_id ORDER BY rank) AS n FROM pool),
k AS (SELECT qid, video_id, n, row_id, true AS kept, [v] AS vs FROM o WHERE n = 1 UNION ALL
  SELECT qid, video_id, n, row_id, ok, CASE WHEN ok THEN list_append(vs, v) ELSE vs END
  FROM (SELECT o.*, k.vs, len(list_filter(k.vs, lambda x: round(list_dot_product(x, o.v), 6) >= 0.2)) < 1 AS ok FROM k JOIN o ON o.qid = k.qid AND o.video_id = k.video_id AND o.n = k.n + 1)),
clean AS (SELECT pool.* FROM k JOIN pool USING (qid, row_id) WHERE kept)"""


def _pool(t: Tables) -> DataFrame:
    """The 100 best rows of each query, with label as video and the vector."""
    return dense.top_k(_vectors(t), _asked(t), 100).join(_vectors(t).withColumnRenamed("label", "video_id"), "row_id")


def _clean(pool: DataFrame) -> DataFrame:
    return greedy.suppress(pool, ["qid", "video_id"], "score", "row_id", F.col("v"), greedy.cosine(0.2))


@query("V6_E16_copy_suppression", f"WITH RECURSIVE {POOL} SELECT qid, row_id, video_id, score, rank FROM clean")
def copy_suppression(t: Tables) -> DataFrame:
    """Of a query's candidates from one video, in score order, those go that are near one that stays."""
    return _clean(_pool(t)).select("qid", "row_id", "video_id", "score", "rank")


@query("E16_dedup_diagnostics", f"""WITH RECURSIVE {POOL}, a AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY qid, video_id ORDER BY rank) AS c FROM pool) WHERE c <= 5),
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY qid, video_id ORDER BY rank) AS c FROM clean) WHERE c <= 5),
x AS (SELECT coalesce(a.qid, b.qid) AS qid, a.row_id IS DISTINCT FROM b.row_id AS moved, coalesce(a.pos, b.pos) AS pos, a.video_id FROM a FULL JOIN b ON a.qid = b.qid AND a.pos = b.pos),
r AS (SELECT qid, count(*) AS n FROM clean GROUP BY qid), p AS (SELECT qid, count(*) AS n FROM pool GROUP BY qid)
SELECT qid, any_value(p.n - r.n) AS removed, count(*) FILTER (WHERE moved) AS shifted, bool_or(moved AND pos = 1) AS top_changed, count(DISTINCT video_id) AS videos FROM x JOIN r USING (qid) JOIN p USING (qid) GROUP BY qid""")
def dedup_diagnostics(t: Tables) -> DataFrame:
    """What suppression does to a query's first 100: rows removed, and in the lists capped at five a video places that changed, a changed first place, and videos."""
    pool = staged(_pool(t))
    clean = staged(_clean(pool).select(*pool.columns))
    sizes = pool.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).join(clean.groupBy("qid").agg(F.count(F.lit(1)).alias("m")), "qid")
    a, b = (ranking.cap(x.select("qid", "row_id", "video_id", "score", "rank"), 5).select("qid", F.col("rank").alias("pos"), F.col("row_id").alias(name), F.col("video_id").alias(f"video_{name}")) for x, name in ((pool, "a"), (clean, "b")))
    moved = a.join(b, ["qid", "pos"], "full_outer").withColumn("moved", ~F.col("a").eqNullSafe(F.col("b")))
    by = moved.groupBy("qid").agg(F.count_if("moved").alias("shifted"), F.bool_or(F.col("moved") & (F.col("pos") == 1)).alias("top_changed"), F.countDistinct("video_a").alias("videos"))
    return by.join(sizes, "qid").select("qid", (F.col("n") - F.col("m")).alias("removed"), "shifted", "top_changed", "videos")


# Fixed shape of W14: cosines of neighbours in the band count, windows of six hours, a chain of three events.
BAND, WINDOW_US, EVENTS = (0.0, 0.2), 6 * 3_600_000_000, 3
W14_SQL = f"""WITH f AS (SELECT label AS video_id, vec_id AS row_id, epoch_us(ts) AS us, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN events ON event_id = vec_id),
o AS (SELECT *, row_number() OVER w AS n, coalesce(CAST(round(list_dot_product(v, lead(v) OVER w), 6) BETWEEN {BAND[0]} AND {BAND[1]} AS INTEGER), 0) AS hit FROM f WINDOW w AS (PARTITION BY video_id ORDER BY us, row_id)),
x AS (SELECT a.video_id, a.row_id, a.n, max(b.n) AS last, sum(CASE WHEN b.n < z.last THEN b.hit ELSE 0 END) AS hits
  FROM o a JOIN (SELECT a.video_id, a.n, max(b.n) AS last FROM o a JOIN o b ON b.video_id = a.video_id AND b.n >= a.n AND b.us - a.us <= {WINDOW_US} GROUP BY ALL) z ON z.video_id = a.video_id AND z.n = a.n
  JOIN o b ON b.video_id = a.video_id AND b.n BETWEEN a.n AND z.last GROUP BY ALL),
r AS (SELECT *, last - n AS pairs, CASE WHEN last - n >= {EVENTS - 1} THEN round(hits / (last - n) * least((last - n) / {2 * EVENTS}.0, 1.0), 6) ELSE 0 END AS score FROM x),
p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, n) AS k FROM r)
SELECT video_id, row_id, CAST(pairs AS BIGINT) AS pairs, score FROM p WHERE k = 1 AND score > 0"""


@query("W14_best_window", W14_SQL)
def best_window(t: Tables) -> DataFrame:
    """The window of a video in which most neighbours change but stay related: their share times how full the window is.

    Cosines of neighbours are a column; counts up to a row, and the last row in reach, give every window without pairs.
    Windows of too few rows do not count; of equal ones the first wins.
    """
    us = t.frames.select("row_id", "us")
    f = _vectors(t).withColumnRenamed("label", "video_id").join(us, "row_id")
    order = Window.partitionBy("video_id").orderBy("us", "row_id")
    near = F.round(dense.dot("v", "after"), 6).between(*BAND)
    o = f.withColumn("after", F.lead("v").over(order)).select("video_id", "row_id", "us", F.coalesce(near.cast("int"), F.lit(0)).alias("hit"))
    o = o.withColumn("n", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum("hit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    reach = Window.partitionBy("video_id").orderBy("us").rangeBetween(0, WINDOW_US)
    o = o.withColumn("pairs", F.max("n").over(reach) - F.col("n")).withColumn("hits", F.max("before").over(reach) - F.col("before"))
    score = F.round(F.col("hits") / F.col("pairs") * F.least(F.col("pairs") / F.lit(2.0 * EVENTS), F.lit(1.0)), 6)
    o = o.withColumn("score", F.when(F.col("pairs") >= EVENTS - 1, score).otherwise(0.0))
    best = Window.partitionBy("video_id").orderBy(F.desc("score"), "n")
    return o.withColumn("k", F.row_number().over(best)).where("k = 1 and score > 0").select("video_id", "row_id", F.col("pairs").cast("long").alias("pairs"), "score")


@query("F1_pool_before_topk", _top_sql(DOT, "a.label <= 3", 5))
def pool_mask(t: Tables) -> DataFrame:
    v = _vectors(t)
    pool = v.where("label <= 3").select("row_id")
    return dense.top_k(v.join(pool, "row_id", "left_semi"), _asked(t), 5)


@query("F4_encoded_rows", "SELECT count(*) AS n, count(*) FILTER (WHERE len(list_filter(embedding[1:8], lambda x: x <> 0)) > 0) AS encoded FROM embeddings")
def encoded_rows(t: Tables) -> DataFrame:
    return t.embeddings.agg(F.count(F.lit(1)).alias("n"), F.count_if(dense.encoded("embedding")).alias("encoded"))


@query("S6_l2_normalise", "SELECT vec_id, round(list_sum(list_transform(list_transform(embedding, lambda x: x::DOUBLE * 3), lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * 3 * y::DOUBLE * 3))))), 4) AS total FROM embeddings")
def normalise(t: Tables) -> DataFrame:
    three = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("e"))
    return three.select("vec_id", F.round(F.aggregate(dense.l2_normalise("e"), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("V3_cached_query_lookup", "SELECT i.item_id AS qid, e.vec_id AS cached FROM benchmark i JOIN embeddings e ON e.vec_id = i.item_id")
def cached_lookup(t: Tables) -> DataFrame:
    """Query vectors come from a cache by key; a miss is an error."""
    asked = t.benchmark.select(F.col("item_id").alias("qid"))
    cache = t.embeddings.select(F.col("vec_id").alias("cached"))
    if asked.join(cache, F.col("qid") == F.col("cached"), "left_anti").limit(1).count():
        raise KeyError("query without cached vector")
    return asked.join(cache, F.col("qid") == F.col("cached"))


@query("V5_A2_chunk_max", f"WITH {QV}, s AS (SELECT b.qid, a.vec_id // 4 AS row_id, max(round({DOT}, 6)) AS score FROM embeddings a, q b GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM s) SELECT qid, row_id, score, rank FROM r WHERE rank <= 10")
def chunk_max(t: Tables) -> DataFrame:
    """Several vectors a row; the best counts. 4k best chunks always hold the k best rows."""
    best = dense.top_k(_vectors(t), _asked(t), 40).withColumn("row_id", F.floor(F.col("row_id") / 4))
    return ranking.top(best.groupBy("qid", "row_id").agg(F.max("score").alias("score")), 10)


def _clauses(t: Tables) -> DataFrame:
    """Two clauses a question: the query vector and the next one."""
    v = _vectors(t)
    return v.where("row_id % 20 in (0, 1)").select((F.col("row_id") - F.col("row_id") % 20).alias("q"), F.col("row_id").alias("qid"), "v")


CLAUSES = f"c AS (SELECT vec_id - vec_id % 20 AS q, vec_id, embedding FROM embeddings WHERE vec_id % 20 IN (0, 1)), s AS (SELECT b.q AS qid, a.vec_id AS row_id, round({DOT}, 6) AS s FROM embeddings a, c b)"


@query("A1_max_over_clauses", f"WITH {CLAUSES}, m AS (SELECT qid, row_id, max(s) AS score FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM m) SELECT qid, row_id, score, rank FROM r WHERE rank <= 10")
def max_over_clauses(t: Tables) -> DataFrame:
    best = dense.top_k(_vectors(t), _clauses(t), 20).join(_clauses(t).select("qid", "q"), "qid")
    return ranking.top(best.groupBy(F.col("q").alias("qid"), "row_id").agg(F.max("score").alias("score")), 10)


@query("V11_max_plus_sum", f"WITH {CLAUSES}, m AS (SELECT qid, row_id, round(max(s) + 0.1 * sum(s), 6) AS score FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM m) SELECT qid, row_id, score, rank FROM r WHERE rank <= 10")
def max_plus_sum(t: Tables) -> DataFrame:
    """The clauses of a question share a block of queries, so a task has all scores of its rows and keeps its k best."""

    def fold(r, q, s):
        s = dense.rounded(s)
        asked, of = np.unique(q["q"].to_numpy(), return_inverse=True)
        hi, total = np.full((len(s), len(asked)), -np.inf), np.zeros((len(s), len(asked)))
        for c, g in enumerate(of):
            hi[:, g] = np.maximum(hi[:, g], s[:, c])
            total[:, g] += s[:, c]
        return dense.best(r, pa.table({"qid": asked}), dense.rounded(hi + 0.1 * total), 10)

    return ranking.top(dense.tiles(_vectors(t).select("row_id", "v"), _clauses(t), fold, "qid long, row_id long, score double", deal="q"), 10)


@query("V12_clause_matrix", f"WITH {CLAUSES} SELECT qid, count(*) AS n, round(avg(s), 4) AS mean FROM s GROUP BY qid")
def clause_matrix(t: Tables) -> DataFrame:
    fold = lambda r, q, s: [q["q"], np.full(s.shape[1], len(s)), dense.rounded(s).sum(axis=0)]
    sums = dense.tiles(_vectors(t).select("row_id", "v"), _clauses(t), fold, "qid long, n long, s double")
    return sums.groupBy("qid").agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 4).alias("mean"))


HUB = f"h AS (SELECT a.vec_id AS row_id, round({DOT}, 6) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({DOT}, 6) DESC, b.vec_id) AS n FROM embeddings a JOIN embeddings b ON a.label <> b.label), hub AS (SELECT row_id, avg(s) AS r_k FROM h WHERE n <= 10 GROUP BY row_id)"


def _hubness(t: Tables, k: int = 10) -> DataFrame:
    v = _vectors(t)
    best = dense.top_k(v, v.withColumnRenamed("row_id", "qid"), k, exclude_same="label")
    return best.groupBy(F.col("qid").alias("row_id")).agg(F.avg("score").alias("r_k"))


@query("J11_A16_hubness", f"WITH {HUB} SELECT row_id, round(r_k, 5) AS r_k FROM hub")
def hubness(t: Tables) -> DataFrame:
    return _hubness(t).select("row_id", F.round("r_k", 5).alias("r_k"))


@query("V9_csls", f"WITH {QV}, {HUB}, s AS (SELECT b.qid, a.vec_id AS row_id, round(2 * round({DOT}, 6) - 0.5 * h2.r_k, 4) AS score FROM embeddings a JOIN hub h2 ON h2.row_id = a.vec_id, q b), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM s) SELECT qid, row_id, score, rank FROM r WHERE rank <= 10")
def csls(t: Tables) -> DataFrame:
    fold = lambda r, q, s: dense.best(r, q, dense.rounded(2 * dense.rounded(s) - 0.5 * r["r_k"].to_numpy()[:, None], 4), 10)
    rows = _vectors(t).select("row_id", "v").join(_hubness(t), "row_id")
    return ranking.top(dense.tiles(rows, _asked(t).select("qid", "v"), fold, "qid long, row_id long, score double"), 10)


@query("V8_A15_qb_norm", f"WITH {QV}, s AS (SELECT b.qid, a.vec_id AS row_id, round({DOT}, 6) AS s FROM embeddings a, q b), l AS (SELECT row_id, sum(exp(s / 0.1)) AS total FROM s GROUP BY row_id), n AS (SELECT qid, row_id, round(s / 0.1 - ln(greatest(total - exp(s / 0.1), 1e-30)), 4) AS score FROM s JOIN l USING (row_id)), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM n) SELECT qid, row_id, score, rank FROM r WHERE rank <= 10")
def qb_norm(t: Tables) -> DataFrame:
    """Two passes over the blocks: each row's sum over the queries, then the k best of each query."""
    v, asked = _vectors(t).select("row_id", "v"), _asked(t).select("qid", "v")
    total = dense.tiles(v, asked, lambda r, q, s: [r["row_id"], np.exp(dense.rounded(s) / 0.1).sum(axis=1)], "row_id long, total double")
    total = total.groupBy("row_id").agg(F.sum("total").alias("total"))

    def fold(r, q, s):
        s = dense.rounded(s)
        others = np.maximum(r["total"].to_numpy()[:, None] - np.exp(s / 0.1), 1e-30)
        return dense.best(r, q, dense.rounded(s / 0.1 - np.log(others), 4), 10)

    return ranking.top(dense.tiles(v.join(total, "row_id"), asked, fold, "qid long, row_id long, score double"), 10)


@query("V10_alpha_expansion", f"WITH {QV}, s AS (SELECT b.qid, a.vec_id AS row_id, a.embedding, round({DOT}, 6) AS s, row_number() OVER (PARTITION BY b.qid ORDER BY round({DOT}, 6) DESC, a.vec_id) AS n FROM embeddings a, q b), x AS (SELECT qid, unnest(range(1, 65)) AS pos, s, embedding FROM s WHERE n <= 5), g AS (SELECT x.qid, pos, sum(pow(greatest(s, 0), 3) * x.embedding[pos]) + any_value(q.embedding[pos]) AS v FROM x JOIN q USING (qid) GROUP BY ALL), w AS (SELECT qid, list(v ORDER BY pos) AS v, sqrt(sum(v * v)) AS norm FROM g GROUP BY qid), y AS (SELECT w.qid, a.vec_id AS row_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), w.v) / norm, 6) AS score FROM embeddings a, w), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM y) SELECT qid, row_id, score, rank FROM r WHERE rank <= 10")
def alpha_expansion(t: Tables) -> DataFrame:
    """A second search with q + the sum of max(s, 0)^3 v over its 5 best rows, at unit length."""
    q, v = _asked(t), _vectors(t)
    best = dense.top_k(v, q, 5).join(v.select("row_id", "v"), "row_id").select("qid", "v", F.pow(F.greatest("score", F.lit(0.0)), 3).alias("w"))
    grown = dense.weighted_sum(best.union(q.select("qid", "v", F.lit(1.0))), ["qid"], "v", F.col("w"))
    return dense.top_k(v, grown.select("qid", dense.l2_normalise("v").alias("v")), 10)


@query("A14_centroid", "SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS pos FROM embeddings) GROUP BY ALL")
def centroid(t: Tables) -> DataFrame:
    return t.embeddings.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("A17_segment_pooling", "WITH p AS (SELECT vec_id // 10 AS seg, pos, max(x) AS hi, avg(x) AS mean FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS pos FROM embeddings) GROUP BY ALL) SELECT seg, pos, round(hi / sqrt(sum(hi * hi) OVER s), 6) AS hi, round(mean / sqrt(sum(mean * mean) OVER s), 6) AS mean FROM p WINDOW s AS (PARTITION BY seg)")
def segment_pooling(t: Tables) -> DataFrame:
    """Greatest and mean component of a segment's vectors, each at unit length; a zero vector stays."""
    parts = t.embeddings.select(F.floor(F.col("vec_id") / 10).alias("seg"), F.posexplode("embedding").alias("pos", "x"))
    x = F.col("x").cast("double")
    pooled = parts.groupBy("seg", F.col("pos").cast("long").alias("pos")).agg(F.max(x).alias("hi"), F.avg(x).alias("mean"))
    unit = lambda c: F.col(c) / F.coalesce(F.nullif(F.sqrt(F.sum(F.col(c) * F.col(c)).over(Window.partitionBy("seg"))), F.lit(0.0)), F.lit(1.0))
    return pooled.select("seg", "pos", F.round(unit("hi"), 6).alias("hi"), F.round(unit("mean"), 6).alias("mean"))


@query("J10_V7_D20_same_group_cosine", f"SELECT a.vec_id AS row_id, a.label AS video_id, round(max({DOT}), 6) AS max_cos, count(*) FILTER (WHERE {DOT} >= 0.5) AS near FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY ALL")
def same_group_cosine(t: Tables) -> DataFrame:
    """Blocks within a label, however many rows it has; a row is not its own neighbour."""

    def fold(r, q, s):
        own = r["row_id"].to_numpy()[:, None] == q["qid"].to_numpy()[None, :]
        s[own] = -np.inf
        return [r["row_id"], r["label"], dense.rounded(s.max(axis=1)), (s >= 0.5).sum(axis=1)]

    v = _vectors(t)
    parts = dense.tiles(v, v.withColumnRenamed("row_id", "qid"), fold, "row_id long, video_id int, max_cos double, near long", within="label")
    return parts.groupBy("row_id", "video_id").agg(F.max("max_cos").alias("max_cos"), F.sum("near").alias("near")).where(F.col("max_cos") > float("-inf"))


@query("V13_alignment_check", f"SELECT count(*) AS pairs, count(*) FILTER (WHERE round({DOT}, 6) >= 0.5) AS similar FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 1")
def alignment_check(t: Tables) -> DataFrame:
    a, b = _vectors(t).alias("a"), _vectors(t).alias("b")
    pairs = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("b.row_id") == F.col("a.row_id") + 1))
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.round(dense.dot("a.v", "b.v"), 6) >= 0.5).alias("similar"))


# Fixed shape of W12: two neighbours on each side, each step away counts half, none more than two hours away.
REACH, FADE, LIMIT_US = 2, 0.5, 2 * 3_600_000_000
_AROUND = " + ".join(f"CASE WHEN abs(us - {side}(us, {k}) OVER w) <= {LIMIT_US} THEN {FADE**k} * {side}(x, {k}) OVER w ELSE 0 END" for k in range(1, REACH + 1) for side in ("lag", "lead"))


def _faded(k: int):
    return lambda a, b: a + FADE**k * b


@query("W12_temporal_smoothing", f"WITH n AS (SELECT vec_id, label, epoch_us(ts) AS us, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS pos FROM embeddings JOIN events ON event_id = vec_id), s AS (SELECT vec_id, pos, x + {_AROUND} AS x FROM n WINDOW w AS (PARTITION BY label, pos ORDER BY us, vec_id)) SELECT vec_id, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS x FROM s")
def smoothing(t: Tables) -> DataFrame:
    """Each vector with its neighbours in time, of the same video and not far off, at unit length."""
    w = Window.partitionBy("label").orderBy("us", "row_id")
    d = _vectors(t).join(t.frames.select("row_id", "us"), "row_id").withColumn("d", F.transform("v", lambda x: x.cast("double")))
    sides = [(f"{side.__name__}{k}", side, k) for k in range(1, REACH + 1) for side in (F.lag, F.lead)]
    near = lambda side, k: F.when(F.abs(F.col("us") - side("us", k).over(w)) <= LIMIT_US, side("d", k).over(w))
    d = d.withColumns({name: near(side, k) for name, side, k in sides})
    total = F.col("d")
    for name, _, k in sides:
        total = F.zip_with(total, F.coalesce(name, F.transform("d", lambda x: F.lit(0.0))), _faded(k))
    unit = d.select(F.col("row_id").alias("vec_id"), total.alias("s")).select("vec_id", dense.l2_normalise("s").alias("s"))
    return unit.select("vec_id", F.posexplode("s").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


# --- BM25 ---------------------------------------------------------------------------

TOKENS = r"tok AS (SELECT id, flatten([w, flatten(list_transform(list_filter(list_transform(string_split_regex(t, '[^\p{L}\p{N}_\s]+'), lambda p: regexp_extract_all(p, '[\p{L}\p{N}_]+')), lambda p: len(p) > 1), lambda p: list_transform(range(1, len(p)), lambda i: p[i] || '_' || p[i + 1])))]) AS tokens FROM (SELECT id, lower(text) AS t, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM src))"


def _bm25_sql(tag: str, docs: str, asked: str) -> str:
    return (
        f"{TOKENS.replace('tok AS', f'dt{tag} AS').replace('FROM src', f'FROM ({docs})')}, {TOKENS.replace('tok AS', f'qt{tag} AS').replace('FROM src', f'FROM ({asked})')}, "
        f"st{tag} AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM dt{tag}), "
        f"p{tag} AS (SELECT id, token, dl, count(*) AS tf FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS token FROM dt{tag}) GROUP BY ALL), "
        f"f{tag} AS (SELECT token, count(*) AS df FROM p{tag} GROUP BY token), "
        f"a{tag} AS (SELECT id AS qid, unnest(list_distinct(tokens)) AS token FROM qt{tag}), "
        f"b{tag} AS (SELECT qid, id AS doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM a{tag} JOIN p{tag} USING (token) JOIN f{tag} USING (token), st{tag} GROUP BY ALL)"
    )


DOCS, ASKED = "SELECT doc_id AS id, text FROM documents WHERE trim(text) <> ''", "SELECT item_id AS id, text FROM benchmark"
FOLD = "replace(strip_accents(lower(trim(text))), 'đ', 'd') AS text"
BM25 = _bm25_sql("", DOCS, ASKED)
DUAL = f"{BM25}, {_bm25_sql('k', DOCS.replace(', text', f', {FOLD}'), ASKED.replace(', text', f', {FOLD}'))}, dual AS (SELECT qid, doc_id, 0.5 * coalesce(b.score, 0) + 0.5 * coalesce(bk.score, 0) AS score FROM b FULL JOIN bk USING (qid, doc_id))"


def _asked_texts(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("qid"), "text")


def _text_top(s: DataFrame, k: int) -> DataFrame:
    return ranking.top(s.withColumn("score", F.round("score", 6)), k, key="doc_id")


def _rank_docs(source: str, k: int) -> str:
    return f"SELECT qid, doc_id, score, rank FROM (SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM {source}) WHERE rank <= {k}"


@query("T6_T7_T11_bm25", f"WITH {BM25} {_rank_docs('b', 10)}")
def bm25_topk(t: Tables) -> DataFrame:
    return _text_top(bm25.scores(t.documents, _asked_texts(t)), 10)


def _dual(t: Tables, k: int) -> DataFrame:
    return bm25.top_k(t.documents.select("doc_id", "text"), _asked_texts(t), k, [EXACT, FOLDED], [0.5, 0.5])


@query("T8_dual_index", f"WITH {DUAL} {_rank_docs('dual', 10)}")
def dual_index(t: Tables) -> DataFrame:
    return ranking.top(_dual(t, 10), 10, key="doc_id")


@query("T9_text_channel_cap", f"WITH {DUAL}, r AS ({_rank_docs('dual', 100)}), c AS (SELECT r.*, d.source AS video_id, row_number() OVER (PARTITION BY qid, d.source ORDER BY rank) AS n FROM r JOIN documents d USING (doc_id)) SELECT qid, doc_id AS row_id, video_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INTEGER) AS rank FROM c WHERE n <= 2")
def text_channel(t: Tables) -> DataFrame:
    top = ranking.top(_dual(t, 100), 100, key="doc_id").join(t.documents.select("doc_id", F.col("source").alias("video_id")), "doc_id")
    return ranking.cap(top.select("qid", F.col("doc_id").alias("row_id"), "video_id", "score", "rank"), 2)


META = "SELECT page_id AS id, url || '. ' || url || '. ' || url || '. ' || html AS text FROM pages"


@query("T10_metadata_channel", f"WITH {_bm25_sql('', META, ASKED)} {_rank_docs('b', 5)}")
def metadata_channel(t: Tables) -> DataFrame:
    """One document a page: the title field three times, then the whole html."""
    meta = t.pages.select(F.col("page_id").alias("doc_id"), F.concat_ws(". ", "url", "url", "url", "html").alias("text"))
    return _text_top(bm25.scores(meta, _asked_texts(t)), 5)


GRAMS = "flatten(list_transform(regexp_extract_all(replace(strip_accents(lower(trim(text))), 'đ', 'd'), '[\\p{L}\\p{N}_]+'), lambda w: list_transform(range(1, greatest(length(w) + 2 - 3 + 1, 1) + 1), lambda i: substr('_' || w || '_', CAST(i AS INTEGER), 3))))"
GRAM_SQL = f"WITH dt AS (SELECT p_partkey AS id, {GRAMS.replace('text', 'p_name')} AS tokens FROM part WHERE trim(p_name) <> ''), st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM dt), p AS (SELECT id, token, dl, count(*) AS tf FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS token FROM dt) GROUP BY ALL), f AS (SELECT token, count(*) AS df FROM p GROUP BY token), a AS (SELECT p_partkey AS qid, unnest(list_distinct({GRAMS.replace('text', 'p_name')})) AS token FROM part WHERE p_partkey % 20 = 0), b AS (SELECT qid, id AS doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM a JOIN p USING (token) JOIN f USING (token), st GROUP BY ALL)"


@query("T12_char_ngram_bm25", f"{GRAM_SQL} {_rank_docs('b', 5)}")
def char_ngrams(t: Tables) -> DataFrame:
    """Names repeat: each is scored once, for all parts that ask it and all that have it."""
    parts = t.part.select(F.col("p_partkey").cast("long").alias("doc_id"), F.col("p_name").alias("text"))
    return bm25.top_k_of_texts(parts, parts.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid"), 5, [CHARS], [1.0])


# --- Labels -------------------------------------------------------------------------

IDF = "idf AS (SELECT label, ln((SELECT count(DISTINCT video_id) FROM e) / (count(DISTINCT video_id) + 1)) AS idf FROM e GROUP BY label)"


def _idf(f: DataFrame) -> DataFrame:
    n = f.agg(F.countDistinct("video_id").alias("n"))
    return f.groupBy("label").agg(F.countDistinct("video_id").alias("df")).crossJoin(F.broadcast(n)).select("label", F.log(F.col("n") / (F.col("df") + 1)).alias("idf"))


@query("A3_A4_label_idf", f"WITH {FRAMES}, {IDF} SELECT label, round(idf, 6) AS idf FROM idf")
def label_idf(t: Tables) -> DataFrame:
    return _idf(t.frames).select("label", F.round("idf", 6).alias("idf"))


@query("A5_object_score", f"WITH {FRAMES}, {IDF}, v AS (SELECT DISTINCT video_id FROM e) SELECT v.video_id, round(coalesce(sum(e.score * idf.idf), 0), 4) AS score FROM v LEFT JOIN (SELECT * FROM e WHERE score >= 0.5 AND label IN ('view', 'click', 'purchase')) e ON e.video_id = v.video_id LEFT JOIN idf ON idf.label = e.label GROUP BY v.video_id")
def object_score(t: Tables) -> DataFrame:
    """Sum of score times idf over every detection of the wanted labels; groups without any get 0."""
    f = t.frames
    hits = f.where((F.col("score") >= 0.5) & F.col("label").isin("view", "click", "purchase")).join(F.broadcast(_idf(f)), "label", "left")
    s = hits.groupBy("video_id").agg(F.sum(F.col("score") * F.coalesce("idf", F.lit(0.0))).alias("s"))
    return f.select("video_id").distinct().join(s, "video_id", "left").select("video_id", F.round(F.coalesce("s", F.lit(0.0)), 4).alias("score"))


@query("A6_object_score_v2", f"WITH {FRAMES}, m AS (SELECT video_id, label, max(score) AS s FROM e GROUP BY ALL), i AS (SELECT label, ln((SELECT count(*) FROM e) / count(*)) AS idf FROM e GROUP BY label) SELECT video_id, round(sum(s * idf), 4) AS total, round(max(s * idf), 4) AS best, round(sum(CASE WHEN idf >= 1.6 THEN s * idf ELSE 0 END), 4) AS rare FROM m JOIN i USING (label) GROUP BY video_id")
def object_score_v2(t: Tables) -> DataFrame:
    f = t.frames
    best = f.groupBy("video_id", "label").agg(F.max("score").alias("s"))
    n = f.agg(F.count(F.lit(1)).alias("n"))
    i = f.groupBy("label").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("label", F.log(F.col("n") / F.col("df")).alias("idf"))
    w = F.col("s") * F.col("idf")
    return best.join(F.broadcast(i), "label").groupBy("video_id").agg(F.round(F.sum(w), 4).alias("total"), F.round(F.max(w), 4).alias("best"), F.round(F.sum(F.when(F.col("idf") >= 1.6, w).otherwise(0.0)), 4).alias("rare"))


#: A token in more documents than this is not rare.
RARE = 200


def rare_shapes(c: Column) -> Column:
    """Words with a digit, a leading capital, a hyphen or six letters, without the signs around them."""
    words = F.array_distinct(F.transform(F.split(c, r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    return F.filter(words, lambda w: (F.length(w) >= 2) & (w.rlike("[0-9]") | (w.rlike(r"^\p{Lu}") & (F.length(w) >= 3)) | w.contains("-") | (F.length(w) >= 6)))


SHAPES = r"list_filter(list_distinct(list_transform(string_split_regex(text, '\s+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))), lambda w: length(w) >= 2 AND (regexp_matches(w, '[0-9]') OR (regexp_matches(w, '^\p{Lu}') AND length(w) >= 3) OR contains(w, '-') OR length(w) >= 6))"


@query("F8_rare_token_all", rf"WITH d AS (SELECT doc_id, {FOLD.replace('AS text', 'AS low')} FROM documents WHERE trim(text) <> ''), df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(low, '[\p{{L}}\p{{N}}]+'))) AS token FROM d) GROUP BY token), q AS (SELECT item_id AS qid, unnest(list_distinct(list_transform({SHAPES}, lambda w: replace(strip_accents(lower(trim(w))), 'đ', 'd')))) AS token FROM benchmark), rare AS (SELECT qid, list(token) AS tokens FROM q JOIN df USING (token) WHERE df <= {RARE} GROUP BY qid) SELECT qid, doc_id FROM rare, d WHERE len(list_filter(tokens, lambda x: NOT contains(low, x))) = 0")
def rare_all(t: Tables) -> DataFrame:
    """Documents that hold all rare tokens of a query as folded substrings; found through one of them, then verified.

    Rare tokens have F10's shape and are words of 1 to RARE documents. A document that holds a token
    as part of another word has a word that contains it, so the candidates come from distinct corpus
    words that contain the query's longest token.
    """
    d = t.documents.where(F.trim("text") != "").select("doc_id", tx.fold_full(F.col("text")).alias("low"))
    tok = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("token"))
    df = tok.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    asked = t.benchmark.select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(F.transform(rare_shapes(F.col("text")), tx.fold_full))).alias("token"))
    rare = asked.join(df, "token").where(F.col("df") <= RARE).groupBy("qid").agg(F.collect_list("token").alias("tokens"))
    # Substrings: every piece of 1 to 6 letters of a corpus word is a key, so containment is an equi-join.
    of_length = lambda n: F.transform(F.sequence(F.lit(1), F.length("token") - n + 1), lambda i: F.substring("token", i, n))
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.length("token"), F.lit(6))), of_length))
    pieces = df.select("token", F.explode(F.array_distinct(pieces)).alias("piece"))
    longest = F.array_max(F.transform("tokens", lambda x: F.struct(F.length(x), x.alias("x"))))["x"]
    first = rare.select("qid", "tokens", longest.alias("first")).withColumn("piece", F.substring("first", 1, 6))
    words = first.join(pieces, "piece").where(F.col("token").contains(F.col("first"))).select("qid", "tokens", "token")
    hits = words.join(tok, "token").select("qid", "tokens", "doc_id").dropDuplicates(["qid", "doc_id"]).join(d, "doc_id")
    return hits.where(F.forall("tokens", lambda x: F.col("low").contains(x))).select("qid", "doc_id")


@query("F10_rare_token_shape", r"SELECT item_id AS qid, len(list_filter(list_distinct(list_transform(string_split_regex(text, '\s+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))), lambda w: length(w) >= 2 AND (regexp_matches(w, '[0-9]') OR (regexp_matches(w, '^\p{Lu}') AND length(w) >= 3) OR contains(w, '-') OR length(w) >= 6))) AS n_rare FROM benchmark")
def rare_shape(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("qid"), F.size(rare_shapes(F.col("text"))).cast("long").alias("n_rare"))


@query("F9_rare_token_any", r"WITH q AS (SELECT item_id AS qid, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 9))) AS token FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS token FROM documents) SELECT qid, doc_id, CAST(100 + 10 * count(*) AS DOUBLE) AS score FROM q JOIN d USING (token) GROUP BY ALL")
def rare_any(t: Tables) -> DataFrame:
    q = t.benchmark.select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(F.filter(tx.unigrams(F.col("text")), lambda w: F.length(w) >= 9))).alias("token"))
    d = t.documents.select("doc_id", F.explode(F.array_distinct(tx.unigrams(F.col("text")))).alias("token"))
    return d.join(q, "token").groupBy("qid", "doc_id").agg((100.0 + 10 * F.count(F.lit(1))).alias("score"))


FLAGSHIP = (
    f"WITH {DUAL}, q AS (SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)), "
    f"s AS (SELECT b.qid, a.vec_id AS row_id, CAST(a.label AS VARCHAR) AS video_id, round({DOT}, 6) AS score FROM embeddings a, q b), "
    "l AS (SELECT qid, row_id, video_id, 0 AS list, 1.0::DOUBLE AS w, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM s QUALIFY rank <= 100 "
    f"UNION ALL SELECT r.qid, r.doc_id, d.source, 1, 0.5::DOUBLE, r.rank FROM ({_rank_docs('dual', 100)}) r JOIN documents d USING (doc_id)), "
    "fz AS (SELECT qid, row_id, round(sum(w / (60 + rank)), 9) AS score, min((list, rank, video_id)) AS first, min_by(video_id, (list, rank, video_id)) AS video_id, string_agg(list || '@' || rank, ',' ORDER BY list, rank) AS sources FROM l GROUP BY qid, row_id), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, row_id) AS pos FROM fz), "
    "c AS (SELECT *, row_number() OVER (PARTITION BY qid, video_id ORDER BY pos) AS n FROM o) "
    "SELECT qid, row_id, video_id, score, sources, CAST(row_number() OVER (PARTITION BY qid ORDER BY pos) AS INTEGER) AS rank FROM c WHERE n <= 20 QUALIFY rank <= 100"
)


def flagship(t: Tables) -> DataFrame:
    """Vectors' and texts' rankings for the same question ids, fused at weights 1.0 and 0.5, capped per group."""
    v = _vectors(t)
    asked = v.join(t.benchmark.select(F.col("item_id").alias("row_id")), "row_id", "left_semi").withColumnRenamed("row_id", "qid")
    a = dense.top_k(v, asked, 100).join(v.select("row_id", F.col("label").cast("string").alias("video_id")), "row_id")
    b = ranking.top(_dual(t, 100), 100, key="doc_id").join(t.documents.select("doc_id", F.col("source").alias("video_id")), "doc_id").withColumnRenamed("doc_id", "row_id")
    return ranking.cap(ranking.rrf([x.select("qid", "row_id", "video_id", "score", "rank") for x in (a, b)], [1.0, 0.5]), 20, 100)


query("flagship_fused_search", FLAGSHIP)(flagship)
