"""Fusion and reranking of ranked lists made from events: label as question, user as video."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameseek.operators import greedy, ranking, sequences
from frameseek.plans.registry import FRAMES, Tables, query

LISTS = f"{FRAMES}, l1 AS (SELECT * FROM (SELECT label AS qid, row_id, video_id, us, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, row_id) AS rank FROM e) WHERE rank <= 100), l2 AS (SELECT * FROM (SELECT label AS qid, row_id, video_id, us, score, row_number() OVER (PARTITION BY label ORDER BY score * (1 + row_id % 7) DESC, row_id) AS rank FROM e) WHERE rank <= 100)"
RRF = "u AS (SELECT *, 0 AS li, 1.0 / (60 + rank) AS part FROM l1 UNION ALL SELECT *, 1, 0.5 / (60 + rank) FROM l2), r AS (SELECT qid, row_id, any_value(video_id) AS video_id, round(sum(part), 9) AS score, min((li, rank)) AS first FROM u GROUP BY qid, row_id), fused AS (SELECT qid, row_id, video_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, row_id) AS rank FROM r)"


def lists(t: Tables) -> tuple[DataFrame, DataFrame]:
    f = t.frames.select(F.col("label").alias("qid"), "row_id", "video_id", "us", "score")
    b = f.withColumn("s2", F.col("score") * (1 + F.col("row_id") % 7))
    return ranking.top(f, 100), ranking.top(b, 100, score="s2").drop("s2")


def fused(t: Tables) -> DataFrame:
    return ranking.rrf(list(lists(t)), [1.0, 0.5])


@query("R1_rrf", f"WITH {LISTS}, {RRF} SELECT qid, row_id, video_id, score, rank FROM fused")
def rrf(t: Tables) -> DataFrame:
    return fused(t).drop("sources")


@query("R5_clause_rrf", f"WITH {LISTS}, {RRF} SELECT qid, row_id, rank FROM fused WHERE rank <= 20")
def clause_rrf(t: Tables) -> DataFrame:
    """The lists are clauses; the question clause has weight 0.5."""
    return fused(t).where("rank <= 20").select("qid", "row_id", "rank")


@query("R2_two_stage_rrf", f"WITH {LISTS}, v1 AS (SELECT qid, video_id, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS rank FROM l1 GROUP BY qid, video_id), v2 AS (SELECT qid, video_id, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS rank FROM l2 GROUP BY qid, video_id), v AS (SELECT qid, video_id, round(sum(1.0 / (60 + rank)), 9) AS v FROM (SELECT * FROM v1 UNION ALL SELECT * FROM v2) GROUP BY ALL), n AS (SELECT qid, row_id, video_id, row_number() OVER (PARTITION BY qid, video_id ORDER BY rank) AS rank FROM l1 UNION ALL SELECT qid, row_id, video_id, row_number() OVER (PARTITION BY qid, video_id ORDER BY rank) FROM l2), s AS (SELECT qid, row_id, video_id, round(sum(1.0 / (60 + rank)), 9) AS s FROM n GROUP BY ALL), b AS (SELECT qid, row_id, video_id, round(v + s, 9) AS score FROM s JOIN v USING (qid, video_id)), c AS (SELECT *, row_number() OVER (PARTITION BY qid, video_id ORDER BY score DESC, row_id) AS k FROM b), o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM c WHERE k <= 2) SELECT qid, row_id, video_id, score, rank FROM o WHERE rank <= 50")
def two_stage(t: Tables) -> DataFrame:
    return ranking.two_stage_rrf(list(lists(t)), 2, 50)


NORMS = "w AS (SELECT *, ln(1 + greatest(score, 0)) AS ls, avg(ln(1 + greatest(score, 0))) OVER q AS lm, stddev_pop(ln(1 + greatest(score, 0))) OVER q AS lsd, min(ln(1 + greatest(score, 0))) OVER q AS llo, max(ln(1 + greatest(score, 0))) OVER q AS lhi, avg(score) OVER q AS m, stddev_pop(score) OVER q AS sd, min(score) OVER q AS lo, max(score) OVER q AS hi FROM l1 WINDOW q AS (PARTITION BY qid))"


@query("R3_normalise", f"WITH {LISTS}, {NORMS} SELECT qid, row_id, round(CASE WHEN lo = hi THEN 0 ELSE (score - m) / sd END, 5) AS z, round(CASE WHEN lo = hi THEN 0 ELSE (score - lo) / (hi - lo) END, 6) AS minmax, round(1 / (1 + exp(-greatest(least(2 * CASE WHEN lo = hi THEN 0 ELSE (score - m) / sd END, 60), -60))), 5) AS sigmoid, round(CASE WHEN llo = lhi THEN 0 ELSE (ls - lm) / lsd END, 5) AS log_z, round(CASE WHEN llo = lhi THEN 0 ELSE (ls - llo) / (lhi - llo) END, 6) AS log_minmax FROM w")
def normalise(t: Tables) -> DataFrame:
    a = lists(t)[0]
    forms = {"z": ("z", 1.0, False, 5), "minmax": ("minmax", 1.0, False, 6), "sigmoid": ("sigmoid", 2.0, False, 5), "log_z": ("z", 1.0, True, 5), "log_minmax": ("minmax", 1.0, True, 6)}
    for name, (how, tau, log, places) in forms.items():
        a = ranking.normalise(a, how, tau, log=log).withColumn(name, F.round("norm", places)).drop("norm")
    return a.select("qid", "row_id", *forms)


@query("R4_score_fusion", f"WITH {LISTS}, n1 AS (SELECT qid, row_id, (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) AS n FROM l1 WINDOW q AS (PARTITION BY qid)), n2 AS (SELECT qid, row_id, (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) AS n FROM l2 WINDOW q AS (PARTITION BY qid)) SELECT qid, row_id, round(1.0 * coalesce(n1.n, 0) + 0.5 * coalesce(n2.n, 0), 6) AS score FROM n1 FULL JOIN n2 USING (qid, row_id)")
def score_fusion(t: Tables) -> DataFrame:
    return ranking.score_fusion(list(lists(t)), [1.0, 0.5])


@query("W2_cap_per_video", f"WITH {LISTS}, c AS (SELECT *, row_number() OVER (PARTITION BY qid, video_id ORDER BY rank) AS n FROM l1) SELECT qid, row_id, video_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS pos FROM c WHERE n <= 1")
def cap(t: Tables) -> DataFrame:
    return ranking.cap(lists(t)[0], 1).select("qid", "row_id", "video_id", F.col("rank").alias("pos"))


@query("W3_W4_video_ranks", f"WITH {LISTS}, v AS (SELECT qid, video_id, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS video_rank FROM l1 GROUP BY qid, video_id) SELECT qid, row_id, row_number() OVER (PARTITION BY qid, video_id ORDER BY rank) AS inner_rank, video_rank FROM l1 JOIN v USING (qid, video_id)")
def video_ranks(t: Tables) -> DataFrame:
    a = lists(t)[0]
    inner = ranking.rank(a, ["qid", "video_id"], F.col("rank"), name="inner_rank")
    return inner.join(ranking.video_order(a), ["qid", "video_id"]).select("qid", "row_id", "inner_rank", "video_rank")


BEST = f"{FRAMES}, b AS (SELECT label, video_id, greatest(max(score), 0) AS s FROM e GROUP BY ALL), ev AS (SELECT *, CASE label WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS i FROM b WHERE label IN ('view', 'click', 'purchase'))"
EVENTS = ("view", "click", "purchase")


def best(t: Tables) -> DataFrame:
    """(video_id, i, s): best score of each video for each event, not under 0."""
    f = t.frames.where(F.col("label").isin(*EVENTS))
    i = F.when(F.col("label") == "view", 0).when(F.col("label") == "click", 1).otherwise(2)
    return f.groupBy("video_id", i.alias("i")).agg(F.greatest(F.max("score"), F.lit(0.0)).alias("s"))


@query("A8_best_per_video", f"WITH {BEST} SELECT video_id, i, s FROM ev")
def best_per_video(t: Tables) -> DataFrame:
    return best(t)


BONUS = "bonus AS (SELECT x.video_id, x.i, x.s + 0.3 * coalesce(p.s, 0) + 0.3 * coalesce(n.s, 0) AS score FROM ev x LEFT JOIN ev p ON p.video_id = x.video_id AND p.i = x.i - 1 LEFT JOIN ev n ON n.video_id = x.video_id AND n.i = x.i + 1)"


def _bonus(t: Tables) -> DataFrame:
    """Best scores of a video with a share of those for the event before and after."""
    w = Window.partitionBy("video_id").orderBy("i").rangeBetween(-1, -1)
    v = Window.partitionBy("video_id").orderBy("i").rangeBetween(1, 1)
    return best(t).select("video_id", "i", (F.col("s") + 0.3 * F.coalesce(F.max("s").over(w), F.lit(0.0)) + 0.3 * F.coalesce(F.max("s").over(v), F.lit(0.0))).alias("score"))


@query("R6_context_bonus", f"WITH {BEST}, {BONUS} SELECT video_id, i, round(score, 6) AS score FROM bonus")
def context_bonus(t: Tables) -> DataFrame:
    return _bonus(t).withColumn("score", F.round("score", 6))


@query("R7_soft_chain_videos", f"WITH {BEST}, {BONUS} SELECT video_id, round(sum(score), 6) AS score FROM bonus GROUP BY video_id")
def soft_chain(t: Tables) -> DataFrame:
    """The sum over events of a video's best scores with their bonus; a video that lacks an event stays."""
    return _bonus(t).groupBy("video_id").agg(F.round(F.sum("score"), 6).alias("score"))


@query("R8_J17_hard_chain_videos", f"WITH {BEST} SELECT video_id, round(sum(s), 6) AS score FROM ev GROUP BY video_id HAVING count(DISTINCT i) = 3")
def hard_chain(t: Tables) -> DataFrame:
    return best(t).groupBy("video_id").agg(F.round(F.sum("s"), 6).alias("score"), F.countDistinct("i").alias("n")).where("n = 3").drop("n")


@query("A10_video_log_sum", f"WITH {BEST} SELECT video_id, round(sum(ln(s + 1e-9)), 5) AS score FROM ev GROUP BY video_id HAVING count(DISTINCT i) = 3")
def log_sum(t: Tables) -> DataFrame:
    return best(t).groupBy("video_id").agg(F.round(F.sum(F.log(F.col("s") + 1e-9)), 5).alias("score"), F.count(F.lit(1)).alias("n")).where("n = 3").drop("n")


@query("A11_combiners", f"WITH {BEST} SELECT video_id, round(sum(s), 6) AS total, round(min(s), 6) AS least, round(count(*) / sum(1 / (s + 1e-9)), 4) AS harmonic FROM ev GROUP BY video_id")
def combiners(t: Tables) -> DataFrame:
    return best(t).groupBy("video_id").agg(F.round(F.sum("s"), 6).alias("total"), F.round(F.min("s"), 6).alias("least"), F.round(F.count(F.lit(1)) / F.sum(1 / (F.col("s") + 1e-9)), 4).alias("harmonic"))


@query("R18_top_videos", f"WITH {BEST}, v AS (SELECT video_id, max(s) AS s FROM ev WHERE s > 0 GROUP BY video_id) SELECT video_id, round(s, 6) AS score FROM v ORDER BY s DESC, video_id LIMIT 20")
def top_videos(t: Tables) -> DataFrame:
    return best(t).where("s > 0").groupBy("video_id").agg(F.max("s").alias("s")).orderBy(F.desc("s"), "video_id").limit(20).select("video_id", F.round("s", 6).alias("score"))


SUPPORT = "t5 AS (SELECT qid, video_id, sum(score) AS sup FROM (SELECT *, row_number() OVER (PARTITION BY qid, video_id ORDER BY rank) AS n FROM l1) WHERE n <= 5 GROUP BY ALL), su AS (SELECT qid, video_id, sup / max(sup) OVER (PARTITION BY qid) AS sup FROM t5)"


@query("A9_R11_video_support", f"WITH {LISTS}, {SUPPORT} SELECT qid, row_id, round(score * (1 + 0.2 * sup), 4) AS score FROM l1 JOIN su USING (qid, video_id)")
def support(t: Tables) -> DataFrame:
    a = lists(t)[0]
    s = ranking.rank(a, ["qid", "video_id"], F.col("rank"), name="n").where("n <= 5").groupBy("qid", "video_id").agg(F.sum("score").alias("sup"))
    s = s.withColumn("sup", F.col("sup") / F.max("sup").over(Window.partitionBy("qid")))
    return a.join(s, ["qid", "video_id"]).select("qid", "row_id", F.round(F.col("score") * (1 + 0.2 * F.col("sup")), 4).alias("score"))


@query("R10_agreement", f"WITH {LISTS}, u AS (SELECT qid, row_id, score FROM l1 UNION ALL SELECT qid, row_id, score FROM l2) SELECT qid, row_id, round(max(score) * (1 + 0.1 * (count(*) - 1)), 4) AS score FROM u GROUP BY ALL")
def agreement(t: Tables) -> DataFrame:
    a, b = lists(t)
    u = a.select("qid", "row_id", "score").union(b.select("qid", "row_id", "score"))
    return u.groupBy("qid", "row_id").agg(F.round(F.max("score") * (1 + 0.1 * (F.count(F.lit(1)) - 1)), 4).alias("score"))


R9_SQL = f"""WITH RECURSIVE {LISTS}, o AS (SELECT qid, video_id, row_id, us, rank, row_number() OVER (PARTITION BY qid, video_id ORDER BY rank) AS n FROM l1),
k AS (SELECT qid, video_id, row_id, rank, n, true AS kept, [us] AS times FROM o WHERE n = 1 UNION ALL
  SELECT o.qid, o.video_id, o.row_id, o.rank, o.n, ok, CASE WHEN ok THEN list_append(times, o.us) ELSE times END
  FROM (SELECT k.qid, k.video_id, k.n, k.times, o.us, len(list_filter(k.times, lambda x: abs(x - o.us) < 86400000000)) = 0 AS ok FROM k JOIN o ON o.qid = k.qid AND o.video_id = k.video_id AND o.n = k.n + 1) j
  JOIN o ON o.qid = j.qid AND o.video_id = j.video_id AND o.n = j.n + 1)
SELECT qid, row_id, rank FROM k WHERE kept"""


@query("R9_time_suppression", R9_SQL)
def time_suppression(t: Tables) -> DataFrame:
    """A candidate goes when one of its video with a higher rank that stays is less than a day away."""
    kept = greedy.suppress(lists(t)[0].drop("rank"), ["qid", "video_id"], "score", "row_id", F.array("us"), greedy.closer(86_400e6))
    return kept.join(lists(t)[0].select("qid", "row_id", "rank"), ["qid", "row_id"]).select("qid", "row_id", "rank")


RERANK = "x AS (SELECT qid, row_id, rank, (row_id * 37 % 101) / 100.0 AS ext FROM l1), sc AS (SELECT qid, row_id, ext, row_number() OVER (PARTITION BY qid ORDER BY ext DESC, rank) AS o FROM x WHERE rank % 3 = 1), sl AS (SELECT qid, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS o FROM x WHERE rank % 3 = 1)"


def _external(a: DataFrame) -> DataFrame:
    return a.select("qid", "row_id", "rank", (F.col("row_id") * 37 % 101 / 100.0).alias("ext"))


@query("R12_R13_rerank_in_place", f"WITH {LISTS}, {RERANK} SELECT qid, sc.row_id, sl.rank FROM sc JOIN sl USING (qid, o) UNION ALL SELECT qid, row_id, rank FROM x WHERE rank % 3 <> 1")
def rerank_in_place(t: Tables) -> DataFrame:
    """Scored rows trade places among themselves by external score; the others keep theirs."""
    x = _external(lists(t)[0])
    scored = x.where("rank % 3 = 1")
    by_score = ranking.rank(scored, ["qid"], F.desc("ext"), F.col("rank"), name="o").select("qid", "o", "row_id")
    places = ranking.rank(scored, ["qid"], F.col("rank"), name="o").select("qid", "o", "rank")
    return by_score.join(places, ["qid", "o"]).select("qid", "row_id", "rank").union(x.where("rank % 3 <> 1").select("qid", "row_id", "rank"))


@query("R13_external_multiply", f"WITH {LISTS}, x AS (SELECT qid, row_id, score, (row_id * 37 % 101) / 100.0 AS ext FROM l1) SELECT qid, row_id, round(score * CASE WHEN max(ext) OVER q = min(ext) OVER q THEN 0.5 ELSE (ext - min(ext) OVER q) / (max(ext) OVER q - min(ext) OVER q) END, 4) AS score FROM x WINDOW q AS (PARTITION BY qid)")
def external_multiply(t: Tables) -> DataFrame:
    w = Window.partitionBy("qid")
    x = lists(t)[0].withColumn("ext", F.col("row_id") * 37 % 101 / 100.0)
    lo, hi = F.min("ext").over(w), F.max("ext").over(w)
    return x.select("qid", "row_id", F.round(F.col("score") * F.when(lo == hi, 0.5).otherwise((F.col("ext") - lo) / (hi - lo)), 4).alias("score"))


def _rerank_sql(key: str) -> str:
    """Rows 1 to 60 whose id is no multiple of three trade places by ``key``."""
    return f"""WITH {LISTS}, x AS (SELECT qid, row_id, rank, score, CASE WHEN row_id % 3 <> 0 THEN (row_id * 37 % 101) / 100.0::DOUBLE END AS ext FROM l1), h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ext DESC, rank) AS h, min(ext) OVER (PARTITION BY qid) AS lo, max(ext) OVER (PARTITION BY qid) AS hi FROM x WHERE rank <= 60 AND ext IS NOT NULL),
k AS (SELECT *, round({key}, 9) AS k FROM h), o AS (SELECT qid, row_id, row_number() OVER (PARTITION BY qid ORDER BY k DESC, rank) AS o FROM k), p AS (SELECT qid, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS o FROM k)
SELECT qid, row_id, rank FROM o JOIN p USING (qid, o) UNION ALL SELECT qid, row_id, rank FROM x WHERE rank > 60 OR ext IS NULL"""


def _reranked(t: Tables, how: str, weight: float) -> DataFrame:
    ext = F.when(F.col("row_id") % 3 != 0, F.col("row_id") * 37 % 101 / 100.0)
    x = lists(t)[0].withColumn("ext", ext).select("qid", "row_id", "rank", "score", "ext")
    return ranking.rerank(x, 60, how, weight).select("qid", "row_id", "rank")


@query("R13_external_replace", _rerank_sql("ext"))
def external_replace(t: Tables) -> DataFrame:
    return _reranked(t, "replace", 1.0)


@query("R13_external_rrf", _rerank_sql("1.0::DOUBLE / (60 + rank) + 2.0::DOUBLE / (60 + h)"))
def external_rrf(t: Tables) -> DataFrame:
    return _reranked(t, "rrf", 2.0)


UNIT = "CASE WHEN hi - lo < 1e-9 THEN 0.5 ELSE (ext - lo) / (hi - lo) END"


@query("R13_external_boost", _rerank_sql(f"score * (1 + 0.5 * ({UNIT}))"))
def external_boost(t: Tables) -> DataFrame:
    return _reranked(t, "multiply", 0.5)


@query("R13_external_lift", _rerank_sql(f"score * (1 + 0.5 * (greatest({UNIT} - 0.5, 0) * 2))"))
def external_lift(t: Tables) -> DataFrame:
    return _reranked(t, "lift", 0.5)


@query("R15_R16_promote_only", f"WITH {LISTS}, x AS (SELECT qid, row_id, rank, (row_id * 37 % 101) / 100.0 AS ext FROM l1) SELECT qid, row_id, row_number() OVER (PARTITION BY qid ORDER BY -greatest(0, round(ext - 0.8, 6)), rank) AS pos FROM x")
def promote(t: Tables) -> DataFrame:
    x = _external(lists(t)[0])
    return ranking.rank(x, ["qid"], -F.greatest(F.lit(0.0), F.round(F.col("ext") - 0.8, 6)), F.col("rank"), name="pos").select("qid", "row_id", "pos")


@query("R14_J8_time_diffusion", f"WITH {LISTS} SELECT a.qid, a.row_id, round(sum(b.score * exp(-pow((a.us - b.us) / 1e6, 2) / (2 * 40000.0 * 40000.0))), 3) AS score FROM l1 a JOIN l1 b ON a.qid = b.qid AND a.video_id = b.video_id AND abs(a.us - b.us) <= 120000000000 GROUP BY ALL")
def diffusion(t: Tables) -> DataFrame:
    """Gaussian-weighted band join within a video, 3 tau wide."""
    a, b = lists(t)[0].alias("a"), lists(t)[0].alias("b")
    gap = F.col("a.us") - F.col("b.us")
    j = a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.video_id") == F.col("b.video_id")) & (F.abs(gap) <= 120_000_000_000))
    return j.groupBy("a.qid", "a.row_id").agg(F.round(F.sum(F.col("b.score") * F.exp(-F.pow(gap / 1e6, 2) / (2 * 40000.0 * 40000.0))), 3).alias("score"))


@query("W17_quota_slots", f"WITH {LISTS}, keep AS (SELECT qid, row_id, rank FROM l1 WHERE rank <= 90), add AS (SELECT qid, row_id, 90 + row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM l2 WHERE NOT EXISTS (SELECT 1 FROM keep k WHERE k.qid = l2.qid AND k.row_id = l2.row_id)) SELECT * FROM keep UNION ALL SELECT * FROM add WHERE rank <= 100")
def quota(t: Tables) -> DataFrame:
    a, b = lists(t)
    keep = a.where("rank <= 90").select("qid", "row_id", F.col("rank").cast("long").alias("rank"))
    add = ranking.rank(b.join(keep, ["qid", "row_id"], "left_anti"), ["qid"], F.col("rank"), name="n").where("n <= 10")
    return keep.union(add.select("qid", "row_id", (F.col("n") + 90).cast("long")))


@query("W18_quota_union")
def quota_union(t: Tables) -> DataFrame:
    """Greedy quotas with first-seen dedup, one bounded group a question."""
    import pandas as pd

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        some = [pdf[pdf["li"] == i].sort_values("rank")["row_id"].tolist() for i in (0, 1)]
        ids = sequences.quota_union(some, [60, 40], 100)
        return pd.DataFrame({"qid": pdf["qid"].iloc[0], "row_id": ids, "pos": range(1, len(ids) + 1)})

    a, b = lists(t)
    u = a.select("qid", "row_id", "rank", F.lit(0).alias("li")).union(b.select("qid", "row_id", "rank", F.lit(1)))
    return u.groupBy("qid").applyInPandas(group, "qid string, row_id long, pos int")


@query("F5_F6_narrow_to_videos", f"WITH {LISTS}, v AS (SELECT qid, video_id FROM (SELECT qid, video_id, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS n FROM l2 GROUP BY qid, video_id) WHERE n <= 10) SELECT qid, row_id, rank FROM l1 SEMI JOIN v USING (qid, video_id)")
def narrow(t: Tables) -> DataFrame:
    a, b = lists(t)
    v = ranking.video_order(b).where("video_rank <= 10")
    return a.join(v, ["qid", "video_id"], "left_semi").select("qid", "row_id", "rank")


@query("F7_R17_soft_priority", f"WITH {LISTS}, v AS (SELECT DISTINCT qid, video_id FROM l2 WHERE rank <= 10) SELECT l1.qid, l1.row_id, row_number() OVER (PARTITION BY l1.qid ORDER BY v.video_id IS NULL, l1.rank) AS pos FROM l1 LEFT JOIN v ON v.qid = l1.qid AND v.video_id = l1.video_id")
def soft_priority(t: Tables) -> DataFrame:
    a, b = lists(t)
    v = b.where("rank <= 10").select("qid", "video_id").distinct().withColumn("in", F.lit(1))
    return ranking.rank(a.join(v, ["qid", "video_id"], "left"), ["qid"], F.col("in").isNull(), F.col("rank"), name="pos").select("qid", "row_id", "pos")


@query("A28_A29_overlap_correlation", f"WITH {LISTS} SELECT qid, count(*) AS overlap, round(corr(-l1.rank, -l2.rank), 6) AS rho FROM l1 JOIN l2 USING (qid, row_id) GROUP BY qid HAVING count(*) >= 5")
def overlap(t: Tables) -> DataFrame:
    a, b = lists(t)
    j = a.select("qid", "row_id", F.col("rank").alias("x")).join(b.select("qid", "row_id", F.col("rank").alias("y")), ["qid", "row_id"])
    return j.groupBy("qid").agg(F.count(F.lit(1)).alias("overlap"), F.round(F.corr(-F.col("x"), -F.col("y")), 6).alias("rho")).where("overlap >= 5")


@query("SO2_SO3_set_ops", f"WITH {LISTS}, i AS (SELECT qid, row_id FROM l1 INTERSECT SELECT qid, row_id FROM l2), d AS (SELECT qid, row_id FROM l1 EXCEPT SELECT qid, row_id FROM l2) SELECT 'both' AS part, qid, count(*) AS n FROM i GROUP BY qid UNION ALL SELECT 'first', qid, count(*) FROM d GROUP BY qid")
def set_ops(t: Tables) -> DataFrame:
    a, b = (x.select("qid", "row_id") for x in lists(t))
    count = lambda d, n: d.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "qid", "n")
    return count(a.intersect(b), "both").union(count(a.subtract(b), "first"))


@query("E17_pool_flooding", f"WITH {LISTS}, t20 AS (SELECT * FROM l1 WHERE rank <= 20) SELECT qid, count(DISTINCT video_id) AS videos, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM t20 b WHERE b.qid = a.qid AND b.video_id = a.video_id AND b.rank < a.rank AND abs(b.us - a.us) <= 864000000000)) AS flooded FROM t20 a GROUP BY qid")
def flooding(t: Tables) -> DataFrame:
    top = lists(t)[0].where("rank <= 20")
    a, b = top.alias("a"), top.alias("b")
    near = (F.col("a.qid") == F.col("b.qid")) & (F.col("a.video_id") == F.col("b.video_id")) & (F.col("b.rank") < F.col("a.rank")) & (F.abs(F.col("a.us") - F.col("b.us")) <= 864_000_000_000)
    hit = a.join(b, near, "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("f"))
    return top.groupBy("qid").agg(F.countDistinct("video_id").alias("videos")).join(hit, "qid", "left").select("qid", "videos", F.coalesce("f", F.lit(0)).cast("long").alias("flooded"))
