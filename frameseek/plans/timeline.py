"""Timeline operators: windows, gaps, runs, bands, chains over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameseek.operators import alignment, chains, numbering, sequences
from frameseek.plans.registry import FRAMES, Tables, query

def line():
    return Window.partitionBy("video_id").orderBy("us", "row_id")


ORD = "o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY us, row_id) AS n FROM e)"


def ordered(t: Tables) -> DataFrame:
    return t.frames.withColumn("n", F.row_number().over(line()))


@query("S9_W13_gap_stats", f"WITH {FRAMES}, g AS (SELECT video_id, us - lag(us) OVER (PARTITION BY video_id ORDER BY us, row_id) AS gap FROM e) SELECT video_id, round(median(gap) / 1e6, 3) AS mid, round(quantile_cont(gap, 0.9) / 1e6, 3) AS p90, round(avg(CASE WHEN gap <= 3600000000 THEN 1.0 ELSE 0.0 END), 6) AS close FROM g WHERE gap IS NOT NULL GROUP BY video_id")
def gaps(t: Tables) -> DataFrame:
    g = t.frames.select("video_id", (F.col("us") - F.lag("us").over(line())).alias("gap")).where("gap is not null")
    return g.groupBy("video_id").agg(F.round(F.expr("percentile(gap, 0.5)") / 1e6, 3).alias("mid"), F.round(F.expr("percentile(gap, 0.9)") / 1e6, 3).alias("p90"), F.round(F.avg(F.when(F.col("gap") <= 3_600_000_000, 1.0).otherwise(0.0)), 6).alias("close"))


@query("S13_S14_gap_filling", f"WITH {FRAMES}, g AS (SELECT video_id, us // 1000000 AS s, lag(us // 1000000) OVER (PARTITION BY video_id ORDER BY us, row_id) AS p FROM e) SELECT video_id, unnest(range(p + 43200, s, 43200)) AS fill FROM g WHERE s - p > 86400")
def gap_filling(t: Tables) -> DataFrame:
    g = t.frames.withColumn("s", F.floor(F.col("us") / 1_000_000)).withColumn("p", F.lag("s").over(line())).where("s - p > 86400")
    return g.select("video_id", F.explode(F.sequence(F.col("p") + 43200, F.col("s") - 1, F.lit(43200).cast("long"))).alias("fill"))


@query("W5_J1_neighbours", f"WITH {FRAMES}, {ORD} SELECT a.row_id, b.row_id AS neighbour FROM o a JOIN o b ON a.video_id = b.video_id AND b.n BETWEEN a.n - 2 AND a.n + 2")
def neighbours(t: Tables) -> DataFrame:
    o = ordered(t)
    # One row meets five keys, so no pair of a long video's rows is made that is not a result.
    a = o.select("row_id", "video_id", F.explode(F.sequence(F.col("n") - 2, F.col("n") + 2)).alias("n")).alias("a")
    b = o.alias("b")
    return a.join(b, (F.col("a.video_id") == F.col("b.video_id")) & (F.col("a.n") == F.col("b.n"))).select("a.row_id", F.col("b.row_id").alias("neighbour"))


NEAR = "s AS (SELECT video_id, n, row_number() OVER (ORDER BY score DESC, row_id) AS seed FROM o QUALIFY seed <= 50), x AS (SELECT o.row_id, s.seed, o.n <> s.n AS is_near, o.us FROM s JOIN o ON o.video_id = s.video_id AND o.n BETWEEN s.n - 2 AND s.n + 2)"


def _seeds(t: Tables) -> DataFrame:
    o = ordered(t)
    s = o.orderBy(F.desc("score"), "row_id").limit(50).withColumn("seed", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "row_id")))
    a, b = s.alias("a"), o.alias("b")
    near = a.join(b, (F.col("a.video_id") == F.col("b.video_id")) & F.col("b.n").between(F.col("a.n") - 2, F.col("a.n") + 2))
    return near.select(F.col("b.row_id").alias("row_id"), "seed", (F.col("b.n") != F.col("a.n")).alias("is_near"), F.col("b.us").alias("us"))


@query("W6_neighbour_expansion", f"WITH {FRAMES}, {ORD}, {NEAR}, m AS (SELECT row_id, min(seed) AS seed, any_value(us) AS us FROM x GROUP BY row_id) SELECT row_id, row_number() OVER (ORDER BY seed, us, row_id) AS pos FROM m QUALIFY pos <= 500")
def neighbour_expansion(t: Tables) -> DataFrame:
    m = _seeds(t).groupBy("row_id").agg(F.min("seed").alias("seed"), F.first("us").alias("us"))
    w = Window.partitionBy(F.lit(1)).orderBy("seed", "us", "row_id")
    return m.withColumn("pos", F.row_number().over(w)).where("pos <= 500").select("row_id", "pos")


@query("W7_interleave_neighbours", f"WITH {FRAMES}, {ORD}, {NEAR}, f AS (SELECT row_id, min((seed, is_near, us)) AS k FROM x GROUP BY row_id) SELECT row_id, row_number() OVER (ORDER BY k, row_id) AS pos FROM f")
def interleave(t: Tables) -> DataFrame:
    f = _seeds(t).groupBy("row_id").agg(F.min(F.struct("seed", "is_near", "us")).alias("k"))
    return f.select("row_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("k", "row_id")).alias("pos"))


@query("W8_W9_sliding_max", f"WITH {FRAMES} SELECT row_id, round(max(CASE WHEN label = 'view' THEN score ELSE 0 END) OVER w + max(CASE WHEN label = 'click' THEN score ELSE 0 END) OVER w, 4) AS score, round(score, 4) AS alone FROM e WINDOW w AS (PARTITION BY video_id ORDER BY us, row_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def sliding_max(t: Tables) -> DataFrame:
    w = line().rowsBetween(-2, 2)
    part = lambda x: F.max(F.when(F.col("label") == x, F.col("score")).otherwise(0.0)).over(w)
    return t.frames.select("row_id", F.round(part("view") + part("click"), 4).alias("score"), F.round("score", 4).alias("alone"))


@query("W10_label_runs", f"WITH {FRAMES}, {ORD}, r AS (SELECT video_id, label, n, n - row_number() OVER (PARTITION BY video_id, label ORDER BY n) AS grp FROM o) SELECT video_id, label, min(n) AS first, count(*) AS length FROM r GROUP BY video_id, label, grp HAVING count(*) >= 2")
def label_runs(t: Tables) -> DataFrame:
    grp = F.col("n") - F.row_number().over(Window.partitionBy("video_id", "label").orderBy("n"))
    return ordered(t).withColumn("grp", grp).groupBy("video_id", "label", "grp").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("length")).where("length >= 2").drop("grp")


@query("W15_rank_margin", f"WITH {FRAMES} SELECT row_id, rank() OVER w AS rank, round(score - lead(score) OVER w, 6) AS margin FROM e WINDOW w AS (PARTITION BY video_id ORDER BY score DESC, row_id)")
def rank_margin(t: Tables) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy(F.desc("score"), "row_id")
    return t.frames.select("row_id", F.rank().over(w).alias("rank"), F.round(F.col("score") - F.lead("score").over(w), 6).alias("margin"))


@query("W19_pad_strided", f"WITH {FRAMES}, p AS (SELECT row_id, video_id FROM e WHERE row_id % greatest(1, (SELECT count(*) FROM e) // 200) = 0 AND NOT EXISTS (SELECT 1 FROM e s WHERE s.score > 90 AND s.video_id = e.video_id AND s.us // 3600000000 = e.us // 3600000000)) SELECT * FROM p ORDER BY row_id LIMIT 100")
def pad(t: Tables) -> DataFrame:
    """Strided rows whose video and hour no chosen row holds yet, until there are 100."""
    f = t.frames.withColumn("hour", F.floor(F.col("us") / 3_600_000_000))
    step = max(1, f.count() // 200)
    seen = f.where("score > 90").select("video_id", "hour").distinct()
    return f.where(F.col("row_id") % step == 0).join(seen, ["video_id", "hour"], "left_anti").select("row_id", "video_id").orderBy("row_id").limit(100)


@query("W20_dedup_then_cut", f"WITH {FRAMES}, k AS (SELECT *, row_number() OVER (PARTITION BY label, video_id, us // 3600000000 ORDER BY score DESC, row_id) AS d FROM e), c AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, row_id) AS rank FROM k WHERE d = 1) SELECT label AS qid, row_id, rank FROM c WHERE rank <= 100")
def dedup_cut(t: Tables) -> DataFrame:
    f = t.frames.withColumn("h", F.floor(F.col("us") / 3_600_000_000))
    d = f.withColumn("d", F.row_number().over(Window.partitionBy("label", "video_id", "h").orderBy(F.desc("score"), "row_id"))).where("d = 1")
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "row_id"))).where("rank <= 100").select(F.col("label").alias("qid"), "row_id", "rank")


@query("W21_nearest_to_seed", f"WITH {FRAMES}, s AS (SELECT DISTINCT video_id, us FROM e WHERE label = 'purchase'), d AS (SELECT e.video_id, e.row_id, min(abs(e.us - s.us)) AS gap FROM e JOIN s ON e.video_id = s.video_id GROUP BY e.video_id, e.row_id) SELECT video_id, row_id, row_number() OVER (PARTITION BY video_id ORDER BY gap, row_id) AS pos FROM d QUALIFY pos <= 5")
def nearest(t: Tables) -> DataFrame:
    """The five rows of a video nearest to any of its seeds; the seeds before and after a row come from windows, not pairs."""
    seed = F.when(F.col("label") == "purchase", F.col("us"))
    before = F.last(seed, ignorenulls=True).over(line().rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(seed, ignorenulls=True).over(Window.partitionBy("video_id").orderBy(F.desc("us"), F.desc("row_id")).rowsBetween(Window.unboundedPreceding, 0))
    g = t.frames.where("video_id is not null").select("video_id", "row_id", F.least(F.col("us") - before, after - F.col("us")).alias("gap")).where("gap is not null")
    w = Window.partitionBy("video_id").orderBy("gap", "row_id")
    return g.withColumn("pos", F.row_number().over(w)).where("pos <= 5").select("video_id", "row_id", "pos")


@query("W23_strided_rows", f"WITH {FRAMES}, {ORD} SELECT video_id, row_id FROM o WHERE (n - 1) % 5 = 0")
def strided(t: Tables) -> DataFrame:
    return ordered(t).where("(n - 1) % 5 = 0").select("video_id", "row_id")


@query("J6_S29_interval_join", "WITH s AS (SELECT conv_id, turn * 10.0 AS a, turn * 10.0 + 8 AS z, text FROM conversations), p AS (SELECT conv_id, CAST(turn * 7 AS DOUBLE) AS pts FROM conversations) SELECT p.conv_id, p.pts, md5(string_agg(s.text, ' ' ORDER BY s.a)) AS said FROM p JOIN s ON s.conv_id = p.conv_id AND s.a - 1 <= p.pts AND p.pts <= s.z + 1 GROUP BY ALL")
def interval_join(t: Tables) -> DataFrame:
    """Points in segments widened by 1 s, same conversation; texts in segment order."""
    at = lambda k: (F.col("turn") * k).cast("double")
    s = t.conversations.select("conv_id", at(10).alias("a"), (at(10) + 8).alias("z"), "text").alias("s")
    p = t.conversations.select("conv_id", at(7).alias("pts")).alias("p")
    j = p.join(s, (F.col("s.conv_id") == F.col("p.conv_id")) & (F.col("s.a") - 1 <= F.col("p.pts")) & (F.col("p.pts") <= F.col("s.z") + 1))
    parts = F.array_sort(F.collect_list(F.struct("s.a", "s.text")))
    return j.groupBy("p.conv_id", "p.pts").agg(F.md5(F.array_join(F.transform(parts, lambda x: x["text"]), " ")).alias("said"))


@query("J7_E3_tolerance_band", f"WITH {FRAMES} SELECT a.row_id, count(*) AS near FROM e a JOIN e b ON a.video_id = b.video_id AND abs(a.us - b.us) <= 3600000000 GROUP BY a.row_id")
def tolerance(t: Tables) -> DataFrame:
    """Rows within the tolerance of a row, itself included; time buckets keep a long video from one group."""
    tol = 3_600_000_000
    cell = F.floor(F.col("us") / tol)
    a = t.frames.select("row_id", "video_id", "us", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")).alias("a")
    b = t.frames.select("video_id", F.col("us").alias("us2"), cell.alias("cell")).alias("b")
    return a.join(b, ["video_id", "cell"]).where(F.abs(F.col("us") - F.col("us2")) <= tol).groupBy("row_id").agg(F.count(F.lit(1)).alias("near"))


@query("J9_asymmetric_window", f"WITH {FRAMES} SELECT DISTINCT b.row_id FROM e a JOIN e b ON a.video_id = b.video_id AND b.us - a.us BETWEEN -3600000000 AND 7200000000 WHERE a.label = 'purchase'")
def asymmetric(t: Tables) -> DataFrame:
    """Rows from an hour before a purchase to two hours after it, by a count over a range of time, without pairs.

    A video is cut into cells of three hours; a purchase also stands in the cells that it reaches.
    """
    hour = 3_600_000_000
    f, cell = t.frames.where("video_id is not null"), lambda us: F.floor(us / (3 * hour))
    reach = F.sequence(cell(F.col("us") - hour), cell(F.col("us") + 2 * hour))
    bought = f.where("label = 'purchase'").select("video_id", "us", F.explode(reach).alias("cell"), "row_id", F.lit(True).alias("bought"))
    rows = f.select("video_id", "us", cell(F.col("us")).alias("cell"), "row_id", F.lit(False).alias("bought"))
    w = Window.partitionBy("video_id", "cell").orderBy("us").rangeBetween(-2 * hour, hour)
    return rows.union(bought).withColumn("near", F.count_if("bought").over(w)).where("not bought and near > 0").select("row_id").distinct()


@query("K8_J12_best_chain", f"WITH {FRAMES}, x AS (SELECT *, max(CASE WHEN label = 'view' THEN score END) OVER w AS b1 FROM e WINDOW w AS (PARTITION BY video_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), y AS (SELECT *, max(CASE WHEN label = 'click' THEN score + b1 END) OVER w AS b2 FROM x WINDOW w AS (PARTITION BY video_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT video_id, round(max(score + b2), 6) AS score FROM y WHERE label = 'purchase' AND b2 IS NOT NULL GROUP BY video_id")
def best_chain(t: Tables) -> DataFrame:
    """Exact best rising chain view, click, purchase: one running maximum an event, no join."""
    before = Window.partitionBy("video_id").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    x = t.frames.withColumn("b1", F.max(F.when(F.col("label") == "view", F.col("score"))).over(before))
    y = x.withColumn("b2", F.max(F.when(F.col("label") == "click", F.col("score") + F.col("b1"))).over(before))
    return y.where("label = 'purchase' and b2 is not null").groupBy("video_id").agg(F.round(F.max(F.col("score") + F.col("b2")), 6).alias("score"))


def pools(t: Tables, k: int = 20, least: float | None = None) -> DataFrame:
    """The k best candidates of each event and video, of a score of ``least`` at least, as arrays: one bounded row a video."""
    f = t.frames.where(F.col("label").isin("view", "click", "purchase") & (F.lit(True) if least is None else F.col("score") >= least)).withColumn("i", F.when(F.col("label") == "view", 0).when(F.col("label") == "click", 1).otherwise(2))
    w = Window.partitionBy("video_id", "i").orderBy(F.desc("score"), "row_id")
    top = f.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return top.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("i", "row_id", (F.col("us") / 1e6).alias("pts"), "score"))).alias("c"))


def _levels(c: list) -> list[list[tuple]]:
    return [[(r["row_id"], r["pts"], r["score"]) for r in c if r["i"] == i] for i in range(3)]


@query("K1_K2_beam_chains")
def beam_chains(t: Tables) -> DataFrame:
    run = F.udf(lambda c: [([int(i) for i in ids], float(round(s, 6))) for ids, s in sequences.beam(_levels(c))], "array<struct<chain:array<long>,score:double>>")
    return pools(t).select("video_id", F.posexplode(run("c")).alias("pos", "x")).select("video_id", "pos", "x.chain", "x.score")


@query("K3_step_penalty", f"WITH {FRAMES}, g AS (SELECT row_id, (us - lag(us) OVER (PARTITION BY video_id ORDER BY us, row_id)) / 1e6 AS gap FROM e) SELECT row_id, round(CASE WHEN gap < 3600 THEN 1 WHEN gap > 86400 THEN 0.0005 * (gap - 86400) ELSE 0 END, 5) AS penalty FROM g WHERE gap IS NOT NULL")
def penalty(t: Tables) -> DataFrame:
    """A constant for steps under an hour, nothing up to a day, then in proportion to the time beyond it."""
    g = t.frames.select("row_id", ((F.col("us") - F.lag("us").over(line())) / 1e6).alias("gap")).where("gap is not null")
    cost = F.when(F.col("gap") < 3600, 1.0).when(F.col("gap") > 86400, 0.0005 * (F.col("gap") - 86400)).otherwise(0.0)
    return g.select("row_id", F.round(cost, 5).alias("penalty"))


ANEW = """r{0} AS (SELECT p.video_id, p.row_id, p.t, p.ord, p.score + coalesce(s.d, 0) AS d, list_concat(coalesce(s.path, []), list_concat(list_transform(range({0} - len(coalesce(s.path, []))), lambda x: NULL::BIGINT), [p.row_id])) AS path
  FROM p LEFT JOIN {1} s ON s.video_id = p.video_id AND s.t < p.t WHERE p.i = {0} QUALIFY row_number() OVER (PARTITION BY p.video_id, p.ord ORDER BY s.d DESC NULLS LAST, s.t, s.ord) = 1),
q{0} AS (SELECT * FROM r{0} UNION ALL SELECT * FROM {1} WHERE video_id NOT IN (SELECT video_id FROM r{0} WHERE video_id IS NOT NULL))""".format


def restart_sql(pool: str) -> str:
    """CTEs from the pool p to chains c (video_id, chain, score); ``pool`` says which rows are candidates."""
    return f"""p AS (SELECT video_id, i, row_id, us / 1e6 AS t, score, row_number() OVER (PARTITION BY video_id, i ORDER BY score DESC, row_id) AS ord FROM (SELECT *, CASE label WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS i FROM e WHERE label IN ('view', 'click', 'purchase') AND {pool}) QUALIFY ord <= 20),
q AS (SELECT video_id, row_id, t, ord, score AS d, [row_id] AS path FROM p WHERE false), {ANEW(0, 'q')}, {ANEW(1, 'q0')}, {ANEW(2, 'q1')},
c AS (SELECT video_id, list_concat(path, list_transform(range(3 - len(path)), lambda x: NULL::BIGINT)) AS chain, round(d, 6) AS score FROM q2 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY d DESC, t, ord) = 1)"""


@query("K6_align_restart", f"WITH {FRAMES}, {restart_sql('true')} SELECT video_id, chain, score FROM c")
def align_restart(t: Tables) -> DataFrame:
    return alignment.align_restart(pools(t), "video_id", 3).select("video_id", "chain", F.round("score", 6).alias("score"))


HOUR = 3600.0
NEXT = """n{0} AS (SELECT video_id, anchor, limit_t, row_id, t, ord, d, path FROM (SELECT s.video_id, s.anchor, s.limit_t, p.row_id, p.t, p.ord, s.d + p.score - 0.5 * CASE WHEN p.t - s.t < 5.0 THEN (5.0 - (p.t - s.t)) / 5.0 WHEN p.t - s.t > 56.0 THEN ((p.t - s.t) - 56.0) / 56.0 ELSE 0.0 END AS d,
  list_concat(s.path, list_concat(list_transform(range({0} - len(s.path)), lambda x: NULL::BIGINT), [p.row_id])) AS path, s.ord AS prev FROM {1} s JOIN p ON p.video_id = s.video_id AND p.i = {0} AND s.first < {0} AND p.t > s.t AND p.t <= s.limit_t QUALIFY row_number() OVER (PARTITION BY s.video_id, s.anchor, p.ord ORDER BY s.d + p.score - 0.5 * CASE WHEN p.t - s.t < 5.0 THEN (5.0 - (p.t - s.t)) / 5.0 WHEN p.t - s.t > 56.0 THEN ((p.t - s.t) - 56.0) / 56.0 ELSE 0.0 END DESC, s.ord) = 1)),
s{0} AS (SELECT video_id, anchor, limit_t, row_id, t, ord, d, path, (SELECT min(i) FROM p WHERE p.video_id = n{0}.video_id) AS first FROM n{0} UNION ALL SELECT video_id, anchor, limit_t, row_id, t, ord, d, path, first FROM {1} WHERE NOT EXISTS (SELECT 1 FROM n{0} WHERE n{0}.video_id = {1}.video_id AND n{0}.anchor = {1}.anchor))""".format
K7_SQL = f"""WITH {FRAMES}, p AS (SELECT video_id, i, row_id, us / 1e6 / 3600.0 AS t, score, row_number() OVER (PARTITION BY video_id, i ORDER BY score DESC, row_id) AS ord FROM (SELECT *, CASE label WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS i FROM e WHERE label IN ('view', 'click', 'purchase')) QUALIFY ord <= 20),
s0 AS (SELECT p.video_id, ord AS anchor, t + 180.0 AS limit_t, row_id, t, ord, score AS d, list_concat(list_transform(range(i), lambda x: NULL::BIGINT), [row_id]) AS path, i AS first FROM p WHERE i = (SELECT min(i) FROM p x WHERE x.video_id = p.video_id)),
{NEXT(1, 's0')}, {NEXT(2, 's1')},
b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY d DESC, anchor, ord) AS k FROM (SELECT *, row_number() OVER (PARTITION BY video_id, anchor ORDER BY d DESC, ord) AS r FROM s2) WHERE r = 1)
SELECT video_id, list_concat(path, list_transform(range(3 - len(path)), lambda x: NULL::BIGINT)) AS chain, round(d, 6) AS score FROM b WHERE k = 1"""


@query("K7_align_drop", K7_SQL)
def align_time(t: Tables) -> DataFrame:
    """One chain a video through view, click and purchase, hours as the unit of time; each candidate of the first event is tried as the start."""
    hours = F.transform("c", lambda x: F.struct(x["i"].alias("i"), x["row_id"].alias("row_id"), (x["pts"] / HOUR).alias("pts"), x["score"].alias("score")))
    chains = alignment.align_time(pools(t).select("video_id", hours.alias("c")), "video_id", 3, cost=0.5, span=180.0)
    return chains.select("video_id", "chain", F.round("score", 6).alias("score"))


@query("K5_strictly_rising", "WITH l AS (SELECT l_orderkey, CAST(floor(l_quantity) AS BIGINT) AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, floor(l_quantity)) AS pos FROM lineitem) SELECT l_orderkey, pos, pos + max(f - pos) OVER (PARTITION BY l_orderkey ORDER BY pos) AS frame FROM l")
def rising(t: Tables) -> DataFrame:
    """An order's quantities as frames, by line; one not above its predecessor becomes that plus one: a fold over the array."""
    raw = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.floor("l_quantity").alias("f")))), lambda x: x["f"])
    start = F.array().cast("array<bigint>")
    step = lambda out, f: F.concat(out, F.array(F.greatest(f, F.coalesce(F.get(out, F.size(out) - 1) + 1, f))))
    c = t.lineitem.groupBy("l_orderkey").agg(raw.alias("raw"))
    frames = c.select("l_orderkey", F.posexplode(F.aggregate("raw", start, step)).alias("pos", "frame"))
    return frames.withColumn("pos", (F.col("pos") + 1).cast("long"))


ENDS = "ends AS (SELECT video_id, min(row_id) AS lo, max(row_id) AS hi FROM e GROUP BY video_id)"
# From chains c with ends: one row a place, filled and spread, raised to rise.
PLACES = """x AS (SELECT c.video_id, i, chain[i + 1] AS x, lo, hi, 24 + c.video_id % 3 AS fps FROM c JOIN ends USING (video_id), (SELECT unnest([0, 1, 2]) AS i)),
y AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS a, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ai, first_value(x IGNORE NULLS) OVER f AS z, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER f AS zi, first_value(x IGNORE NULLS) OVER w AS k, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER w AS ki
  FROM x WINDOW b AS (PARTITION BY video_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY video_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), w AS (PARTITION BY video_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
g AS (SELECT *, CAST(CASE WHEN x IS NOT NULL THEN x WHEN a IS NOT NULL AND z IS NOT NULL THEN a + round_even((z - a) * (i - ai) / (zi - ai), 0) WHEN a IS NOT NULL THEN least(hi, a + round_even((hi - a) * (i - ai) / 3, 0)) ELSE greatest(lo, z - round_even((z - lo) * (zi - i) / 3, 0)) END AS BIGINT) AS filled,
  CAST(lo + round_even((hi - lo) / 4 * (i + 1), 0) AS BIGINT) AS wide, CAST(greatest(lo, least(hi, round_even(k + (i - ki) * (56.6 * fps / 2), 0))) AS BIGINT) AS narrow FROM y WHERE k IS NOT NULL),
h AS (SELECT *, hi > lo AND max(CASE WHEN i = 2 THEN filled END) OVER v - max(CASE WHEN i = 0 THEN filled END) OVER v < 100 AS heap, hi > lo AND (max(CASE WHEN i = 1 THEN filled END) OVER v - max(CASE WHEN i = 0 THEN filled END) OVER v < 100 OR max(CASE WHEN i = 2 THEN filled END) OVER v - max(CASE WHEN i = 1 THEN filled END) OVER v < 100) AS tight FROM g WINDOW v AS (PARTITION BY video_id)),
up AS (SELECT video_id, i, filled, CAST(i + max(CASE WHEN heap THEN wide ELSE filled END - i) OVER u AS BIGINT) AS total, CAST(i + max(CASE WHEN tight THEN wide ELSE filled END - i) OVER u AS BIGINT) AS pair, CAST(i + max(CASE WHEN tight THEN narrow ELSE filled END - i) OVER u AS BIGINT) AS narrow FROM h WINDOW u AS (PARTITION BY video_id ORDER BY i))"""
K7_CHAINS = K7_SQL.rpartition("\nSELECT ")[0] + ",\nc AS (SELECT " + K7_SQL.rpartition("\nSELECT ")[2] + ")"


@query("K11_K12_fill_and_spread", f"{K7_CHAINS}, {ENDS}, {PLACES} SELECT video_id, i, filled, total, pair, narrow FROM up")
def fill_and_spread(t: Tables) -> DataFrame:
    """The aligned chains with their gaps filled, and as answered when a heap is judged by its ends, by any pair, and spread over the usual length."""
    c = align_time(t).join(t.frames.groupBy("video_id").agg(F.min("row_id").alias("lo"), F.max("row_id").alias("hi")), "video_id")
    chain, lo, hi, fps = F.col("chain"), F.col("lo"), F.col("hi"), 24 + F.col("video_id") % 3
    forms = {"filled": chains.fill(chain, lo, hi), "total": chains.finished(chain, lo, hi), "pair": chains.finished(chain, lo, hi, "pair"), "narrow": chains.finished(chain, lo, hi, "pair", fps)}
    rows = c.where(F.exists("chain", lambda x: x.isNotNull())).select("video_id", F.arrays_zip(*[f.alias(n) for n, f in forms.items()]).alias("z"))
    return rows.select("video_id", F.posexplode("z").alias("i", "z")).select("video_id", "i", "z.*")


W22_SQL = f"""{K7_CHAINS}, f AS (SELECT video_id, row_id, row_number() OVER (PARTITION BY video_id ORDER BY row_id) - 1 AS p, count(*) OVER (PARTITION BY video_id) AS n FROM e),
spots AS (SELECT c.video_id, f0.p AS a0, f1.p AS a1, f2.p AS a2, f0.n FROM c JOIN f f0 ON f0.video_id = c.video_id AND f0.row_id = chain[1] JOIN f f1 ON f1.video_id = c.video_id AND f1.row_id = chain[2] JOIN f f2 ON f2.video_id = c.video_id AND f2.row_id = chain[3] WHERE a0 < a1 AND a1 < a2),
o AS (SELECT x, y, z, greatest(abs(x), abs(y), abs(z)) AS r FROM (SELECT unnest(range(-9, 10)) AS x), (SELECT unnest(range(-9, 10)) AS y), (SELECT unnest(range(-9, 10)) AS z)),
w AS (SELECT video_id, n, a0 + x AS p0, a1 + y AS p1, a2 + z AS p2, row_number() OVER (PARTITION BY video_id ORDER BY r, x, y, z) - 1 AS pos FROM spots, o WHERE a0 + x >= 0 AND a0 + x < a1 + y AND a1 + y < a2 + z AND a2 + z < n)
SELECT w.video_id, pos, f0.row_id AS first, f1.row_id AS second, f2.row_id AS third FROM w JOIN f f0 ON f0.video_id = w.video_id AND f0.p = p0 JOIN f f1 ON f1.video_id = w.video_id AND f1.p = p1 JOIN f f2 ON f2.video_id = w.video_id AND f2.p = p2 WHERE pos < 20"""


@query("W22_chain_spreading", W22_SQL)
def chain_spreading(t: Tables) -> DataFrame:
    """Each whole aligned chain and its nearest variants among the video's frames, twenty in all, shifts of up to nine frames."""
    c = align_time(t).where(F.forall("chain", lambda x: x.isNotNull()) & (F.size("chain") == 3)).select("video_id", "chain")
    f = numbering.placed(t.frames.select("video_id", "row_id"), "video_id", [F.asc("row_id")], "p", "_n").select("video_id", "row_id", (F.col("p") - 1).cast("int").alias("p"))
    sizes = f.groupBy("video_id").agg(F.count(F.lit(1)).cast("int").alias("size"))
    spots = c.select("video_id", F.posexplode("chain").alias("i", "row_id")).join(f, ["video_id", "row_id"]).groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]).alias("at"))
    rising = (F.col("at")[0] < F.col("at")[1]) & (F.col("at")[1] < F.col("at")[2])
    variants = chains.around(spots.where(rising).join(sizes, "video_id"), "video_id", 3, 20, 10)
    back = variants.select("video_id", "pos", F.posexplode("at").alias("i", "p")).join(f, ["video_id", "p"])
    name = lambda i, n: F.max(F.when(F.col("i") == i, F.col("row_id"))).alias(n)
    return back.groupBy("video_id", "pos").agg(name(0, "first"), name(1, "second"), name(2, "third"))


BUDGET = "SELECT video_id, score, row_number() OVER (ORDER BY score DESC, video_id) AS place FROM v"


@query("K4_K9_row_budget", f"WITH {FRAMES}, v AS (SELECT video_id, round(sum(score), 4) AS score FROM e GROUP BY video_id), p AS ({BUDGET}) SELECT video_id, place, CASE WHEN place <= 5 THEN [32, 20, 12, 10, 6][CAST(place AS INTEGER)] ELSE 1 END AS budget FROM p WHERE place <= 25")
def budget(t: Tables) -> DataFrame:
    """80 rows to the five best videos by fixed shares (banker's rounding), then one each to twenty more."""
    v = t.frames.groupBy("video_id").agg(F.round(F.sum("score"), 4).alias("score")).orderBy(F.desc("score"), "video_id").limit(25)
    p = v.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "video_id")))
    share = F.get(F.array(*[F.lit(x) for x in (0.40, 0.25, 0.15, 0.12, 0.08)]), F.col("place") - 1)
    return p.select("video_id", "place", F.when(F.col("place") <= 5, F.bround(80 * share)).otherwise(1).cast("int").alias("budget"))


@query("K10_head_tail_pools", f"WITH {FRAMES}, v AS (SELECT video_id, round(sum(score), 4) AS score FROM e GROUP BY video_id), a AS ({BUDGET} QUALIFY place <= 5), w AS (SELECT video_id, count(*) AS n FROM e WHERE video_id NOT IN (SELECT video_id FROM a) GROUP BY video_id), b AS (SELECT video_id, 5 + row_number() OVER (ORDER BY n DESC, video_id) AS place FROM w) SELECT video_id, place FROM a UNION ALL SELECT video_id, place FROM b WHERE place <= 25")
def head_tail(t: Tables) -> DataFrame:
    f, one = t.frames, F.lit(1)
    a = f.groupBy("video_id").agg(F.round(F.sum("score"), 4).alias("score")).orderBy(F.desc("score"), "video_id").limit(5)
    head = a.select("video_id", F.row_number().over(Window.partitionBy(one).orderBy(F.desc("score"), "video_id")).cast("long").alias("place"))
    b = f.groupBy("video_id").agg(F.count(one).alias("n")).join(head, "video_id", "left_anti").orderBy(F.desc("n"), "video_id").limit(20)
    return head.union(b.select("video_id", (F.row_number().over(Window.partitionBy(one).orderBy(F.desc("n"), "video_id")) + 5).cast("long")))


@query("K14_partial_coverage", f"WITH {FRAMES}, b AS (SELECT video_id, label, max(score) AS s FROM e WHERE label IN ('view', 'click', 'purchase') AND score > 60 GROUP BY ALL) SELECT video_id, round(count(*) / 3.0 + avg(s), 5) AS score FROM b GROUP BY video_id HAVING count(*) < 3")
def partial(t: Tables) -> DataFrame:
    b = t.frames.where(F.col("label").isin("view", "click", "purchase") & (F.col("score") > 60)).groupBy("video_id", "label").agg(F.max("score").alias("s"))
    return b.groupBy("video_id").agg(F.round(F.count(F.lit(1)) / 3.0 + F.avg("s"), 5).alias("score"), F.count(F.lit(1)).alias("n")).where("n < 3").drop("n")


@query("A12_A13_video_bounds", f"WITH {FRAMES} SELECT video_id, min(row_id) AS first, max(row_id) AS last, min(us) AS us0, max(us) AS us1, arg_min(score, row_id) AS fps FROM e GROUP BY video_id")
def bounds(t: Tables) -> DataFrame:
    return t.frames.groupBy("video_id").agg(F.min("row_id").alias("first"), F.max("row_id").alias("last"), F.min("us").alias("us0"), F.max("us").alias("us1"), F.min_by("score", "row_id").alias("fps"))
