"""Evaluation over ranked lists of events; gold rows are those whose id leaves 3 modulo 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameseek.functions import text as tx
from frameseek.operators import evaluate as ev
from frameseek.plans.fusion import LISTS, RRF, fused, lists
from frameseek.plans.registry import FRAMES, Tables, query

# Questions: a label and a day of the month; each ranks its own rows by score.
RANKED = f"{FRAMES}, k AS (SELECT label || '/' || (us // 86400000000 % 28) AS qid, row_id, video_id, us, score, (row_id % 97 = 3) AS gold FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank, row_number() OVER (PARTITION BY qid ORDER BY score, row_id) AS rank2 FROM k), h AS (SELECT qid, min(rank) FILTER (WHERE gold AND rank <= 100) AS rank, min(rank2) FILTER (WHERE gold AND rank2 <= 100) AS rank2 FROM r GROUP BY qid HAVING bool_or(gold))"
SCORE = "(coalesce(CAST({0} <= 1 AS INT), 0) + coalesce(CAST({0} <= 5 AS INT), 0) + coalesce(CAST({0} <= 20 AS INT), 0) + coalesce(CAST({0} <= 50 AS INT), 0) + coalesce(CAST({0} <= 100 AS INT), 0)) / 5"
SC = f"{RANKED}, s AS (SELECT qid, rank, {SCORE.format('rank')} AS a, {SCORE.format('rank2')} AS b FROM h)"


def ranked(t: Tables) -> DataFrame:
    qid = F.concat_ws("/", "label", (F.floor(F.col("us") / 86_400_000_000) % 28))
    k = t.frames.select(qid.alias("qid"), "row_id", "video_id", "us", "score", (F.col("row_id") % 97 == 3).alias("gold"))
    by = lambda *o: F.row_number().over(Window.partitionBy("qid").orderBy(*o))
    return k.withColumn("rank", by(F.desc("score"), "row_id")).withColumn("rank2", by("score", "row_id"))


def scored(t: Tables) -> DataFrame:
    r = ranked(t).groupBy("qid").agg(F.max("gold").alias("g"), F.min(F.when(F.col("gold") & (F.col("rank") <= 100), F.col("rank"))).alias("rank"), F.min(F.when(F.col("gold") & (F.col("rank2") <= 100), F.col("rank2"))).alias("rank2")).where("g")
    return r.select("qid", "rank", ev.question_score(F.col("rank")).alias("a"), ev.question_score(F.col("rank2")).alias("b"))


@query("E1_E2_question_scores", f"WITH {SC} SELECT qid, rank, a AS score FROM s")
def question_scores(t: Tables) -> DataFrame:
    r = ranked(t)
    gold = r.where("gold").select("qid", "row_id")
    h = ev.first_hit(r.where("rank <= 100"), gold, ["row_id"])
    return h.select("qid", "rank", ev.question_score(F.col("rank")).alias("score"))


@query("A20_score_by_type", f"WITH {SC} SELECT coalesce(split_part(qid, '/', 1), 'total') AS kind, count(*) AS n, round(avg(a), 6) AS score FROM s GROUP BY ROLLUP (split_part(qid, '/', 1))")
def by_type(t: Tables) -> DataFrame:
    s = scored(t).withColumn("k", F.split("qid", "/")[0])
    return s.rollup("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 6).alias("score")).select(F.coalesce("k", F.lit("total")).alias("kind"), "n", "score")


@query("E8_A21_J3_paired", f"WITH {SC} SELECT round(avg(a - b), 6) AS mean, count(*) FILTER (WHERE a > b) AS win, count(*) FILTER (WHERE a < b) AS loss, count(*) FILTER (WHERE a = b) AS tie, round(2 * coalesce(stddev_samp(a - b), 0) / sqrt(count(*)), 6) AS se2 FROM s")
def paired(t: Tables) -> DataFrame:
    s = scored(t)
    both = s.select("qid", "a").join(s.select("qid", "b"), "qid")
    return ev.paired(both, "a", "b")


TOL = "tol AS (SELECT unnest([2, 15]) AS tol)"
BAND = f"{RANKED}, {TOL}, g AS (SELECT qid, video_id, us FROM k WHERE gold), c AS (SELECT r.qid, tol.tol, min(r.rank) AS rank FROM r, tol WHERE r.rank <= 100 AND EXISTS (SELECT 1 FROM g WHERE g.qid = r.qid AND g.video_id = r.video_id AND abs(g.us - r.us) <= tol.tol * 3600000000) GROUP BY ALL), q AS (SELECT DISTINCT qid, tol.tol FROM g, tol), ts AS (SELECT q.qid, q.tol, {SCORE.format('c.rank')} AS score FROM q LEFT JOIN c USING (qid, tol))"


def tolerant(t: Tables) -> DataFrame:
    """(qid, tol, score): a row counts within tol hours of a gold row of its video."""
    r = ranked(t)
    tol = F.explode(F.array(F.lit(2), F.lit(15))).alias("tol")
    g = r.where("gold").select(F.col("qid").alias("gq"), F.col("video_id").alias("gv"), F.col("us").alias("gus"))
    hit = (F.col("qid") == F.col("gq")) & (F.col("video_id") == F.col("gv")) & (F.abs(F.col("us") - F.col("gus")) <= F.col("tol").cast("long") * 3_600_000_000)
    c = r.where("rank <= 100").select("qid", "video_id", "us", "rank", tol).join(g, hit, "left_semi").groupBy("qid", "tol").agg(F.min("rank").alias("rank"))
    q = r.where("gold").select("qid").distinct().select("qid", tol)
    return q.join(c, ["qid", "tol"], "left").select("qid", "tol", ev.question_score(F.col("rank")).alias("score"))


@query("E6_E7_two_tolerances", f"WITH {BAND} SELECT tol, count(*) AS n, round(avg(score), 6) AS score FROM ts GROUP BY tol")
def two_tolerances(t: Tables) -> DataFrame:
    return tolerant(t).groupBy("tol").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("score"))


@query("E9_stability_verdict", f"WITH {BAND}, d AS (SELECT tol, ts.score - s.b AS d FROM ts JOIN (SELECT qid, {SCORE.format('rank2')} AS b FROM h) s USING (qid)), m AS (SELECT tol, avg(d) AS mean, 2 * coalesce(stddev_samp(d), 0) / sqrt(count(*)) AS se2 FROM d GROUP BY tol) SELECT CASE WHEN min(sign(mean)) * max(sign(mean)) < 0 THEN 'flip' WHEN max(abs(mean)) = 0 THEN 'no change' WHEN bool_and(abs(mean) > se2) THEN 'stable' ELSE 'weak' END AS verdict FROM m")
def verdict(t: Tables) -> DataFrame:
    d = tolerant(t).join(scored(t).select("qid", "b"), "qid").withColumn("d", F.col("score") - F.col("b"))
    m = d.groupBy("tol").agg(F.avg("d").alias("mean"), (2 * F.coalesce(F.stddev_samp("d"), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias("se2"))
    return m.agg(F.when(F.min(F.signum("mean")) * F.max(F.signum("mean")) < 0, "flip").when(F.max(F.abs("mean")) == 0, "no change").when(F.bool_and(F.abs("mean") > F.col("se2")), "stable").otherwise("weak").alias("verdict"))


@query("E10_decomposition", f"WITH {SC} SELECT split_part(qid, '/', 1) AS kind, count(*) AS n, round(avg(a), 6) AS score, round(1 - avg(a), 6) AS lost, round(avg(coalesce(CAST(rank <= 5 AS INT), 0)), 6) AS r5, median(rank) AS mid, count(*) FILTER (WHERE rank IS NULL) AS misses FROM s GROUP BY ALL")
def decomposition(t: Tables) -> DataFrame:
    return scored(t).groupBy(F.split("qid", "/")[0].alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 6).alias("score"), F.round(1 - F.avg("a"), 6).alias("lost"), F.round(F.avg(F.coalesce((F.col("rank") <= 5).cast("int"), F.lit(0))), 6).alias("r5"), F.median("rank").alias("mid"), F.count_if(F.col("rank").isNull()).alias("misses"))


@query("E11_F12_ceiling", f"WITH {RANKED} SELECT count(*) AS n, count(rank) AS reachable, round(count(rank) / count(*), 6) AS ceiling FROM h")
def ceiling(t: Tables) -> DataFrame:
    return scored(t).agg(F.count(F.lit(1)).alias("n"), F.count("rank").alias("reachable"), F.round(F.count("rank") / F.count(F.lit(1)), 6).alias("ceiling"))


@query("E12_E18_video_hit", f"WITH {RANKED}, g AS (SELECT DISTINCT qid, video_id FROM k WHERE gold), v AS (SELECT r.qid, min(rank) AS rank FROM r SEMI JOIN g USING (qid, video_id) GROUP BY r.qid) SELECT qid, rank, rank <= 1 AS h1, rank <= 5 AS h5, rank <= 20 AS h20 FROM v")
def video_hit(t: Tables) -> DataFrame:
    r = ranked(t)
    v = ev.first_hit(r, r.where("gold").select("qid", "video_id"), ["video_id"])
    return v.select("qid", "rank", (F.col("rank") <= 1).alias("h1"), (F.col("rank") <= 5).alias("h5"), (F.col("rank") <= 20).alias("h20"))


@query("W16_rank_of_gold", f"WITH {RANKED} SELECT qid, row_id, rank FROM r WHERE gold")
def rank_of_gold(t: Tables) -> DataFrame:
    return ranked(t).where("gold").select("qid", "row_id", "rank")


@query("E4_channel_chain_score", f"WITH {SC} SELECT split_part(s.qid, '/', 2) AS day, round(sum(a) / 5, 6) AS score FROM s GROUP BY day")
def channel_chain(t: Tables) -> DataFrame:
    """A day's events are its five labels; a missing one counts 0."""
    return scored(t).groupBy(F.split("qid", "/")[1].alias("day")).agg(F.round(F.sum("a") / 5, 6).alias("score"))


CHAIN = f"{RANKED}, c AS (SELECT qid, rank, (CAST(row_id % 3 = 0 AS INT) + CAST(row_id % 5 = 0 AS INT) + CAST(row_id % 7 = 0 AS INT)) / 3 AS part FROM r WHERE rank <= 100)"


@query("E5_E22_submission_chain_score", f"WITH {CHAIN} SELECT qid, round((max(part) FILTER (WHERE rank <= 1) + max(part) FILTER (WHERE rank <= 5) + max(part) FILTER (WHERE rank <= 20) + max(part) FILTER (WHERE rank <= 50) + max(part)) / 5, 6) AS score FROM c GROUP BY qid")
def submission_chain(t: Tables) -> DataFrame:
    """Position i must match event i; per cut-off the best share so far."""
    flags = F.array(*[(F.col("row_id") % m == 0).cast("int") for m in (3, 5, 7)])
    part = F.aggregate(flags, F.lit(0), lambda s, x: s + x) / 3
    c = ranked(t).where("rank <= 100").withColumn("part", part)
    best = [F.max(F.when(F.col("rank") <= k, F.col("part"))) for k in ev.CUTS]
    return c.groupBy("qid").agg(F.round((best[0] + best[1] + best[2] + best[3] + best[4]) / 5, 6).alias("score"))


@query("E15_score_buckets", f"WITH {SC} SELECT CASE WHEN rank IS NULL THEN 'none' WHEN rank <= 1 THEN 'first' WHEN rank <= 20 THEN 'near' ELSE 'far' END AS bucket, count(*) AS n, round(sum(a), 4) AS total FROM s GROUP BY bucket")
def buckets(t: Tables) -> DataFrame:
    b = F.when(F.col("rank").isNull(), "none").when(F.col("rank") <= 1, "first").when(F.col("rank") <= 20, "near").otherwise("far")
    return scored(t).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("a"), 4).alias("total"))


@query("E19_answer_containment", "WITH a AS (SELECT lower(text) AS ans, strip_accents(lower(text)) AS bare FROM benchmark), d AS (SELECT lower(text) AS low, strip_accents(lower(text)) AS plain FROM documents) SELECT count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM d WHERE contains(low, ans))) AS raw, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM d WHERE contains(plain, bare))) AS folded FROM a")
def containment(t: Tables) -> DataFrame:
    """Passages that some document holds whole, as written in lower case and folded.

    A document that holds a passage has each of its inner words (all but the first and last) whole, so
    candidates come from the rarest of them; passages without an inner word meet every document.
    """
    a = t.benchmark.select(F.col("item_id").alias("no"), F.lower("text").alias("ans"), tx.fold_marks(F.col("text")).alias("bare"))
    d = t.documents.select(F.lower("text").alias("low"), tx.fold_marks(F.col("text")).alias("plain"))
    words = tx.unigrams(F.col("bare"))
    inner = F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))
    keyed = a.select("no", F.explode(inner).alias("token"))
    # What is broadcast are words of the passages, a table that does not grow with the documents.
    tok = d.select(F.explode(F.array_distinct(tx.unigrams(F.col("plain")))).alias("token"))
    df = tok.join(F.broadcast(keyed.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    key = keyed.join(df, "token").groupBy("no").agg(F.min(F.struct("df", "token"))["token"].alias("token")).join(a, "no")
    keys = key.agg(F.collect_set("token").alias("keys"))
    near = d.crossJoin(F.broadcast(keys)).select("low", "plain", F.array_intersect(tx.unigrams(F.col("plain")), "keys").alias("held")).where(F.size("held") > 0)
    near = near.select("low", "plain", F.explode("held").alias("token")).join(F.broadcast(key), "token").drop("token")
    short = a.where(F.size(inner) == 0).crossJoin(d).select(near.columns)
    # A passage as written is found folded too: the fold goes letter by letter.
    hit = near.unionByName(short).where(F.col("plain").contains(F.col("bare"))).groupBy("no").agg(F.max(F.col("low").contains(F.col("ans"))).alias("raw"))
    return a.join(hit, "no", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if("raw").alias("raw"), F.count("raw").alias("folded"))


E20_SQL = r"""WITH a AS (SELECT turn, array_to_string(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '')[1:2], ' ') AS g, array_to_string(list_filter(string_split_regex(coalesce(lead(text) OVER w, ''), '\s+'), lambda w: w <> '')[1:3], ' ') AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT *, trim(regexp_replace(lower(g), '[^\p{L}\p{N}_\s]', '', 'g')) AS gk, trim(regexp_replace(lower(a), '[^\p{L}\p{N}_\s]', '', 'g')) AS ak FROM a)
SELECT turn, count(*) AS n, count(*) FILTER (WHERE g = a) AS exact, count(*) FILTER (WHERE gk = ak AND gk <> '') AS folded, count(*) FILTER (WHERE gk <> '' AND ak <> '' AND (contains(ak, gk) OR contains(gk, ak))) AS inside, count(*) FILTER (WHERE ak = '') AS blank FROM k GROUP BY turn"""


@query("E20_answer_match", E20_SQL)
def answer_match(t: Tables) -> DataFrame:
    """How a turn's first two words and the next turn's first three agree: as they are, without case and signs, and one inside the other."""
    words = lambda c, n: F.array_join(F.slice(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""), 1, n), " ")
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""))
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = t.conversations.select("turn", words(F.col("text"), 2).alias("g"), words(after, 3).alias("a")).select("turn", "g", "a", key(F.col("g")).alias("gk"), key(F.col("a")).alias("ak"))
    both = (F.col("gk") != "") & (F.col("ak") != "")
    inside = both & (F.contains("ak", "gk") | F.contains("gk", "ak"))
    return c.groupBy("turn").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("g") == F.col("a")).alias("exact"), F.count_if((F.col("gk") == F.col("ak")) & (F.col("gk") != "")).alias("folded"), F.count_if(inside).alias("inside"), F.count_if(F.col("ak") == "").alias("blank"))


@query("E21_four_way_ablation", f"WITH {RANKED} SELECT qid, min(rank) FILTER (WHERE gold) AS any_answer, min(rank) FILTER (WHERE gold AND video_id % 2 = 0) AS shared_answer, min(rank) FILTER (WHERE gold AND row_id % 2 = 0) AS row_answer, min(rank) FILTER (WHERE gold AND row_id % 2 = 0 AND score > 20) AS keyword_answer FROM r GROUP BY qid")
def ablation(t: Tables) -> DataFrame:
    first = lambda c: F.min(F.when(F.col("gold") & c, F.col("rank")))
    even = F.col("row_id") % 2 == 0
    return ranked(t).groupBy("qid").agg(first(F.lit(True)).alias("any_answer"), first(F.col("video_id") % 2 == 0).alias("shared_answer"), first(even).alias("row_answer"), first(even & (F.col("score") > 20)).alias("keyword_answer"))


@query("E23_audit_summary", "SELECT quality, count(*) AS n, round(avg(toxic), 6) AS rate, round(sqrt(avg(toxic) * (1 - avg(toxic)) / count(*)), 6) AS se FROM labels GROUP BY quality")
def audit(t: Tables) -> DataFrame:
    p = F.avg("toxic")
    return t.labels.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.round(p, 6).alias("rate"), F.round(F.sqrt(p * (1 - p) / F.count(F.lit(1))), 6).alias("se"))


@query("E24_variant_oracle", r"WITH n AS (SELECT conv_id, turn, text, regexp_extract_all(coalesce(text, ''), '\p{Lu}\p{L}+') AS v FROM conversations), g AS (SELECT conv_id, turn, v[1:3] AS v, lag(v[-1]) OVER (PARTITION BY conv_id ORDER BY turn, text) AS gold FROM n) SELECT conv_id, turn, gold, list_contains(v, gold) AS ok FROM g WHERE gold IS NOT NULL")
def variants(t: Tables) -> DataFrame:
    """The gold is the last capitalised word of the turn before; right if any of a turn's first three equals it."""
    n = t.conversations.select("conv_id", "turn", "text", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\p{Lu}\p{L}+"), F.lit(0)).alias("v"))
    gold = F.lag(F.try_element_at("v", F.lit(-1))).over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    g = n.select("conv_id", "turn", F.slice("v", 1, 3).alias("v"), gold.alias("gold")).where("gold is not null")
    return g.select("conv_id", "turn", "gold", F.exists("v", lambda v: v == F.col("gold")).alias("ok"))


@query("E13_devset_rules", "SELECT rule, count(*) AS n FROM (SELECT 'empty' AS rule FROM documents WHERE trim(text) = '' UNION ALL SELECT 'long' FROM documents WHERE n_chars > 10000 UNION ALL SELECT 'language' FROM documents WHERE lang NOT IN ('en', 'fr') UNION ALL SELECT 'size' FROM documents WHERE n_chars IS DISTINCT FROM length(text) UNION ALL SELECT 'copy' FROM documents GROUP BY text HAVING count(*) > 1 UNION ALL SELECT 'sources' FROM documents GROUP BY text HAVING count(DISTINCT source) > 1 UNION ALL SELECT 'twice' FROM documents GROUP BY doc_id HAVING count(*) > 1 UNION ALL SELECT 'no answer' FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id AND l.quality IS NOT NULL UNION ALL SELECT 'no document' FROM labels l ANTI JOIN documents d ON d.doc_id = l.doc_id) GROUP BY rule")
def devset_rules(t: Tables) -> DataFrame:
    """Violations of nine rules: of one row, of equal texts, of ids, of labels; a rule that nothing breaks has no row.

    Rows are checked in one scan, and equal texts are grouped once, by digest.
    """
    d, one = t.documents, F.lit(1)
    row = F.array(F.when(F.trim("text") == "", "empty"), F.when(F.col("n_chars") > 10000, "long"), F.when(~F.col("lang").isin("en", "fr"), "language"), F.when(~F.col("n_chars").eqNullSafe(F.length("text")), "size"))
    copies = d.groupBy(F.md5("text").alias("digest")).agg(F.count(one).alias("c"), F.countDistinct("source").alias("sources"))
    group = F.array(F.when(F.col("c") > 1, "copy"), F.when(F.col("sources") > 1, "sources"))
    broken = lambda rows, rules: rows.select(F.explode(F.array_compact(rules)).alias("rule"))
    always = lambda rows, name: rows.select(F.lit(name).alias("rule"))
    labels = t.labels
    every = broken(d, row).union(broken(copies, group)).union(always(d.groupBy("doc_id").count().where("count > 1"), "twice"))
    every = every.union(always(d.join(labels.where("quality is not null"), "doc_id", "left_anti"), "no answer")).union(always(labels.join(d, "doc_id", "left_anti"), "no document"))
    return every.groupBy("rule").agg(F.count(one).alias("n"))
