"""Result assembly, file sources and sinks as queries, detection boxes, and the streaming extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameseek.operators import alignment, chains, detections, greedy, numbering
from frameseek.operators.staging import staged
from frameseek.plans.fusion import LISTS, RRF, fused
from frameseek.plans.registry import FRAMES, Tables, query
from frameseek.plans.timeline import ENDS, PLACES, pools, restart_sql


@query("W1_KIS_answers", f"WITH {LISTS}, {RRF} SELECT qid, video_id, row_id AS frame_idx, rank FROM fused WHERE rank <= 100")
def kis_answers(t: Tables) -> DataFrame:
    return fused(t).where("rank <= 100").select("qid", "video_id", F.col("row_id").alias("frame_idx"), "rank")


@query("T27_answer_variants", f"WITH {LISTS}, {RRF}, v AS (SELECT qid, row_id, rank, unnest([1, 2, 3]) AS k FROM fused WHERE rank <= 50), o AS (SELECT qid, row_id, 'a' || CASE WHEN rank <= 10 THEN k ELSE 1 END AS answer, row_number() OVER (PARTITION BY qid ORDER BY rank, k) AS pos FROM v WHERE rank <= 10 OR k = 1) SELECT qid, row_id, answer, pos FROM o WHERE pos <= 100")
def answer_variants(t: Tables) -> DataFrame:
    """The first ten rows carry three answer variants, the others one; then the cut at 100."""
    v = fused(t).where("rank <= 50").withColumn("k", F.explode(F.when(F.col("rank") <= 10, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1)))))
    pos = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "k"))
    return v.withColumn("pos", pos).where("pos <= 100").select("qid", "row_id", F.concat(F.lit("a"), "k").alias("answer"), "pos")


MOST_CHAINS = 140
K13_SQL = f"""WITH {FRAMES}, {restart_sql('score >= 90')}, {ENDS}, {PLACES},
b AS (SELECT video_id, sum(s) AS s FROM (SELECT video_id, i, max(score) AS s FROM p GROUP BY video_id, i) GROUP BY video_id),
d AS (SELECT u.video_id, list(total ORDER BY i) AS frames, row_number() OVER (ORDER BY round(any_value(b.s), 4) DESC, u.video_id) AS pos FROM up u JOIN b USING (video_id) GROUP BY u.video_id QUALIFY pos <= {MOST_CHAINS}),
l AS (SELECT ends.*, row_number() OVER (ORDER BY video_id) - 1 AS n FROM ends WHERE video_id NOT IN (SELECT video_id FROM d)),
m AS (SELECT {MOST_CHAINS} - (SELECT count(*) FROM d) AS want, (SELECT count(*) FROM l) AS have),
a AS (SELECT video_id, i, lo + round_even((hi - lo) / 4 * (i + 1), 0) AS x, row_number() OVER (PARTITION BY i ORDER BY n) AS k FROM l, m, (SELECT unnest([0, 1, 2]) AS i) WHERE n % greatest(1, have // greatest(want, 1)) = 0),
r AS (SELECT video_id, k, i, CAST(i + max(x - i) OVER (PARTITION BY video_id ORDER BY i) AS BIGINT) AS x FROM a, m WHERE k <= want)
SELECT pos, video_id, frames[1] AS first, frames[2] AS second, frames[3] AS third FROM d
UNION ALL SELECT (SELECT count(*) FROM d) + k, video_id, max(x) FILTER (WHERE i = 0), max(x) FILTER (WHERE i = 1), max(x) FILTER (WHERE i = 2) FROM r GROUP BY video_id, k"""


@query("K13_chain_assembly", K13_SQL)
def chain_assembly(t: Tables) -> DataFrame:
    """Answers of one chain a video: the videos with candidates by the sum of their best scores, their chains aligned,
    filled, spread where they are a heap and made to rise; then evenly picked other videos with frames all over them."""
    f = t.frames
    ends = f.where("video_id is not null").groupBy("video_id").agg(F.min("row_id").alias("lo"), F.max("row_id").alias("hi"))
    pool = pools(t, 20, 90.0).where("video_id is not null")
    best = lambda i: F.coalesce(F.array_max(F.transform(F.filter("c", lambda x: x["i"] == i), lambda x: x["score"])), F.lit(0.0))
    ranked = pool.select("video_id", F.round(best(0) + best(1) + best(2), 4).alias("s"))
    found = alignment.align_restart(pool, "video_id", 3).join(ranked, "video_id").join(ends, "video_id")
    found = found.select("video_id", "s", chains.finished(F.col("chain"), F.col("lo"), F.col("hi")).alias("frames")).where("frames is not null")
    top = staged(found.orderBy(F.desc("s"), "video_id").limit(MOST_CHAINS))
    one = Window.partitionBy(F.lit(1))  # at most MOST_CHAINS rows
    top = top.select(F.row_number().over(one.orderBy(F.desc("s"), "video_id")).cast("long").alias("pos"), "video_id", "frames")
    want = MOST_CHAINS - top.count()
    left = staged(numbering.numbered(ends.join(top, "video_id", "left_anti"), [F.asc("video_id")], "n"))
    step = max(1, left.count() // max(want, 1))
    pad = left.where(F.col("n") % step == 0).orderBy("n").limit(max(want, 0))
    wide = F.transform(chains.rising(chains.spread_wide(F.lit(3), F.col("lo"), F.col("hi"))), lambda x: x.cast("long"))
    pad = pad.select((F.row_number().over(one.orderBy("n")) + (MOST_CHAINS - want)).cast("long").alias("pos"), "video_id", wide.alias("frames"))
    return top.union(pad).select("pos", "video_id", *[F.col("frames")[i].alias(n) for i, n in enumerate(("first", "second", "third"))])


# Boxes of an order's lines, on a grid of five by six units: corner by discount and tax, side by quantity; a larger price is surer.
BOXES = "b AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS score, round(l_discount * 500) AS y0, round(l_tax * 600) AS x0, round(l_discount * 500) + l_quantity AS y1, round(l_tax * 600) + l_quantity AS x1 FROM lineitem)"
SHARED = "greatest(least({0}[3], {1}[3]) - greatest({0}[1], {1}[1]), 0) * greatest(least({0}[4], {1}[4]) - greatest({0}[2], {1}[2]), 0)".format
AREA = "(({0}[3] - {0}[1]) * ({0}[4] - {0}[2]))".format


def boxes(t: Tables) -> DataFrame:
    y, x = F.round(F.col("l_discount") * 500), F.round(F.col("l_tax") * 600)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("score"), F.array(y, x, y + F.col("l_quantity"), x + F.col("l_quantity")).alias("box"))


@query("V15_iou", f"WITH {BOXES}, c AS (SELECT l_orderkey, l_linenumber, [y0, x0, y1, x1] AS a, lag([y0, x0, y1, x1]) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, score) AS p FROM b), i AS (SELECT *, {SHARED('a', 'p')} AS s FROM c WHERE p IS NOT NULL) SELECT l_orderkey, l_linenumber, round(s / ({AREA('a')} + {AREA('p')} - s), 6) AS iou FROM i")
def iou(t: Tables) -> DataFrame:
    """A box with the one of the line before it."""
    c = boxes(t).withColumn("p", F.lag("box").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "score"))).where("p is not null")
    return c.select("l_orderkey", "l_linenumber", F.round(detections.iou(F.col("box"), F.col("p")), 6).alias("iou"))


@query("V15_merged_boxes", f"""WITH RECURSIVE {BOXES}, o AS (SELECT l_orderkey, [y0, x0, y1, x1] AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) AS n FROM b),
k AS (SELECT l_orderkey, n, [a] AS kept FROM o WHERE n = 1 UNION ALL
  SELECT k.l_orderkey, o.n, CASE WHEN len(list_filter(kept, lambda x: {SHARED('x', 'o.a')} > 0.5 * ({AREA('x')} + {AREA('o.a')} - {SHARED('x', 'o.a')}))) = 0 THEN list_append(kept, o.a) ELSE kept END FROM k JOIN o ON o.l_orderkey = k.l_orderkey AND o.n = k.n + 1)
SELECT l_orderkey, max(n) AS boxes, CAST(max(len(kept)) AS BIGINT) AS merged FROM k GROUP BY l_orderkey""")
def merged_boxes(t: Tables) -> DataFrame:
    """Boxes of an order, and how many stay when one over half on a surer one that stays is the same thing."""
    b = boxes(t)
    kept = greedy.suppress(b, ["l_orderkey"], "score", "l_linenumber", F.col("box"), greedy.overlap(0.5))
    every = b.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("boxes"))
    return every.join(kept.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("merged")), "l_orderkey")


@query("session_windows_extension", f"WITH {FRAMES}, g AS (SELECT *, CASE WHEN us - lag(us) OVER w > 86400000000 OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY video_id ORDER BY us, row_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY us, row_id) AS k FROM g) SELECT video_id, min(us) AS first_us, count(*) AS n FROM s GROUP BY video_id, k")
def session_windows(t: Tables) -> DataFrame:
    from frameseek.streaming.sessions import sessions

    return sessions(t.frames.withColumn("at", F.timestamp_micros("us")), "1 day").select("video_id", "first_us", "n")
