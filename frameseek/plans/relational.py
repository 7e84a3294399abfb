"""Relational idioms: sources, filters, joins, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameseek.operators import packing
from frameseek.plans.registry import FRAMES, Tables, query, shared

# --- Scans and ETL ------------------------------------------------------------------


shared("S3_critical_missing", "SELECT d.doc_id, l.quality IS NULL AS no_label, d.lang IS NULL AS no_lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL OR d.lang IS NULL", "documents labels")


@query("S8_S10_json_props", "SELECT event_id, CASE WHEN json_valid(props) THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, props IS NOT NULL AND NOT json_valid(props) AS bad FROM events")
def json_props(t: Tables) -> DataFrame:
    """A record that is no JSON is kept with a mark and without values; a missing one is not marked."""
    r = F.from_json("props", "k long, _corrupt_record string", {"mode": "PERMISSIVE"})
    return t.events.select("event_id", "props", r.alias("r")).select("event_id", "r.k", (F.col("props").isNotNull() & (F.col("r").isNull() | F.col("r._corrupt_record").isNotNull())).alias("bad"))


@query("S12_log_compaction", "SELECT user_id, arg_max(event_type, event_id) AS last FROM events WHERE event_type <> '' GROUP BY user_id")
def compaction(t: Tables) -> DataFrame:
    return t.events.where("event_type <> ''").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last"))


shared("S16_J5_resume", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE d.doc_id = l.doc_id)", "documents labels")


# A patched copy: one customer in a hundred changed, a few rows lost; the priority is a column that may differ.
shared("S18_integrity_diff", "WITH a AS (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN -1 ELSE o_custkey END AS o_custkey, 'patched' AS o_orderpriority FROM orders WHERE o_orderkey % 1000 <> 7) SELECT (SELECT count(*) FROM a) AS rows_before, (SELECT count(*) FROM b) AS rows_after, (SELECT count(*) FROM (SELECT o_orderkey FROM a EXCEPT ALL SELECT o_orderkey FROM b) x) AS keys_lost, (SELECT count(*) FROM (SELECT o_orderkey, o_custkey FROM a EXCEPT ALL SELECT o_orderkey, o_custkey FROM b) x) AS differ_before, (SELECT count(*) FROM (SELECT o_orderkey, o_custkey FROM b EXCEPT ALL SELECT o_orderkey, o_custkey FROM a) x) AS differ_after", "orders")


@query("S19_overlay_merge", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -embedding[1] ELSE embedding[1] END AS x FROM embeddings")
def overlay(t: Tables) -> DataFrame:
    """Non-zero rows of the patch replace the base's."""
    base = t.embeddings.select("vec_id", "embedding")
    patch = base.where("vec_id % 3 = 0").select("vec_id", F.transform("embedding", lambda v: -v).alias("p"))
    v = F.when(F.exists("p", lambda x: x != 0), F.col("p")).otherwise(F.col("embedding"))
    return base.join(patch, "vec_id", "left").select("vec_id", F.element_at(v, 1).alias("x"))


shared("S20_cache_insert", "SELECT doc_id, 'base' AS origin FROM labels UNION ALL SELECT d.doc_id, 'new' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)", "labels documents")


@query("S21_union_by_name", "SELECT 'a' AS origin, doc_id AS id, lang, NULL AS url FROM documents UNION ALL SELECT 'b', page_id, NULL, url FROM pages")
def union_by_name(t: Tables) -> DataFrame:
    a = t.documents.select(F.lit("a").alias("origin"), F.col("doc_id").alias("id"), "lang")
    return a.unionByName(t.pages.select(F.lit("b").alias("origin"), F.col("page_id").alias("id"), "url"), allowMissingColumns=True)


shared("S22_coverage", "SELECT d.source, count(DISTINCT d.doc_id) AS docs, count(DISTINCT l.doc_id) AS labelled, count(CASE WHEN l.quality = 1 THEN 1 END) AS good FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source", "documents labels")


@query("S27_text_merge", "SELECT a.conv_id, array_to_string(list_filter([trim(a.text), trim(b.text)], lambda x: x IS NOT NULL AND x <> ''), ' . ') AS text FROM (SELECT * FROM conversations WHERE turn = 0) a LEFT JOIN (SELECT * FROM conversations WHERE turn = 1) b USING (conv_id)")
def text_merge(t: Tables) -> DataFrame:
    from frameseek.functions.text import join_texts

    a = t.conversations.where("turn = 0").select("conv_id", F.col("text").alias("a"))
    b = t.conversations.where("turn = 1").select("conv_id", F.col("text").alias("b"))
    return a.join(b, "conv_id", "left").select("conv_id", join_texts(F.col("a"), F.col("b")).alias("text"))


@query("S28_J16_full_outer_text", "SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, concat_ws(' . ', a.text, b.text) AS text FROM (SELECT * FROM conversations WHERE turn = 2) a FULL JOIN (SELECT * FROM conversations WHERE turn = 4) b ON a.conv_id = b.conv_id")
def full_outer_text(t: Tables) -> DataFrame:
    a = t.conversations.where("turn = 2").select("conv_id", F.col("text").alias("a"))
    b = t.conversations.where("turn = 4").select("conv_id", F.col("text").alias("b"))
    return a.join(b, "conv_id", "full_outer").select("conv_id", F.concat_ws(" . ", "a", "b").alias("text"))


shared("S30_S33_S34_shard_checks", "SELECT o_custkey % 4 AS part, count(*) AS n, count(DISTINCT o_custkey) AS keys, count(CASE WHEN o_totalprice IS NULL THEN 1 END) AS missing, count(CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7) THEN 1 END) AS overlap FROM orders GROUP BY o_custkey % 4", "orders lineitem")
# Parts are turns by four; a conversation in several parts overlaps, and its last part's last turn is kept.
shared("S33_shard_merge", "WITH p AS (SELECT turn % 4 AS part, conv_id, turn, text, length(text) AS size FROM conversations), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part DESC, turn DESC) AS back FROM p), s AS (SELECT conv_id, count(DISTINCT part) AS parts FROM p GROUP BY conv_id) SELECT o.part, count(*) AS n, count(CASE WHEN trim(coalesce(o.text, '')) = '' THEN 1 END) AS blank, count(DISTINCT CASE WHEN s.parts > 1 THEN o.conv_id END) AS overlap, abs(median(o.size) / (SELECT median(size) FROM p) - 1) > 0.4 AS drifts, count(CASE WHEN o.back = 1 THEN 1 END) AS kept FROM o JOIN s ON s.conv_id = o.conv_id GROUP BY o.part", "conversations")
shared("S31_asset_fallback", "SELECT d.doc_id, coalesce(p.url, 'thumb/' || d.source, 'none') AS image FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id", "documents pages")


@query("S35_pool_export", "SELECT label, list((vec_id) ORDER BY vec_id)[1:5] AS pool FROM embeddings GROUP BY label")
def pool_export(t: Tables) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    top = t.embeddings.select("label", "vec_id", F.row_number().over(w).alias("n")).where("n <= 5")
    return top.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "vec_id"))), lambda x: x["vec_id"]).alias("pool"))


# --- Filters and samples ------------------------------------------------------------

shared("F2_video_and_image", "SELECT page_id FROM pages WHERE url LIKE 'http://m.%' AND html IS NOT NULL", "pages")
shared("F3_common_pool", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) INTERSECT SELECT page_id FROM pages", "documents labels pages")
shared("F13_single_kind", "WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_returnflag), s AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS kinds FROM c) SELECT l_orderkey, l_returnflag, n FROM s WHERE kinds = 1 AND n BETWEEN 2 AND 5", "lineitem")
shared("F14_stratified_groups", "WITH s AS (SELECT DISTINCT lang, source FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY source) AS n FROM s) SELECT d.doc_id FROM documents d JOIN r ON r.lang = d.lang AND r.source = d.source WHERE r.n <= 3", "documents")
shared("F15_one_per_group", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || CAST(doc_id AS STRING))) AS n FROM documents) SELECT source, doc_id FROM r WHERE n = 1", "documents")
shared("F16_balanced_sample", "WITH r AS (SELECT doc_id, quality, toxic, row_number() OVER (PARTITION BY quality, toxic ORDER BY md5('5:' || CAST(doc_id AS STRING))) AS n FROM labels) SELECT doc_id, quality, toxic FROM r WHERE n <= 3", "labels")
shared("F17_md5_split", "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || CAST(doc_id AS STRING)), doc_id) AS n, count(*) OVER (PARTITION BY lang) AS c FROM documents) SELECT doc_id, n <= round(c * 0.15) AS held_out FROM r", "documents")
shared("F18_strip_band", "WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events) SELECT event_id FROM r WHERE n > 0.12 * c AND n <= 0.88 * c", "events")
shared("F19_F20_unused_good", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND lower(d.text) NOT LIKE '%token = %'", "documents labels")
shared("F21_leakage", "SELECT round(CAST(count(l.doc_id) AS DOUBLE) / count(*), 6) AS share, CAST(count(l.doc_id) AS DOUBLE) / count(*) >= 0.1 AS warn FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id", "documents labels")


F22_SQL = """WITH RECURSIVE d AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source NULLS LAST) AS k FROM documents GROUP BY source),
b AS (SELECT 0 AS k, [0, 0, 0, 0]::BIGINT[] AS load, NULL::BIGINT AS place UNION ALL
  SELECT d.k, list_transform(load, lambda x, i: x + CASE WHEN i = list_position(load, list_min(load)) THEN d.n ELSE 0 END), list_position(load, list_min(load)) FROM b JOIN d ON d.k = b.k + 1)
SELECT source, n, CAST(place - 1 AS INTEGER) AS bin FROM d JOIN b USING (k)"""


@query("F22_bin_packing", F22_SQL)
def bin_packing(t: Tables) -> DataFrame:
    """Sources into four bins, largest first into the least filled."""
    n = t.spark.read.parquet(f"{t.sf_dir}/documents.parquet").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return packing.longest_first(n, "source", "n", 4).select("source", "n", "bin")


shared("F23_row_pickers", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 95)", "events")
shared("F24_object_compatible", "SELECT DISTINCT e.user_id FROM events e JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) i ON i.event_type = e.event_type WHERE e.value > 90 AND i.n < (SELECT avg(n) FROM (SELECT count(*) AS n FROM events GROUP BY event_type) z)", "events")
shared("F25_source_classes", "SELECT CASE WHEN l.doc_id IS NULL THEN 'none' WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END AS class, count(*) AS n, round(avg(d.n_chars), 3) AS size FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY CASE WHEN l.doc_id IS NULL THEN 'none' WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END", "documents labels")

# --- Joins --------------------------------------------------------------------------

shared("J2_J14_left_and_using", "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE o.o_totalprice > 200000", "orders customer nation")
shared("J4_semi_join", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority LIKE '1%')", "customer orders")


@query("J13_reverse_lookup", "SELECT user_id, event_type, list(event_id ORDER BY event_id) AS events FROM events GROUP BY user_id, event_type")
def reverse_lookup(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list("event_id")).alias("events"))


# --- Aggregates ---------------------------------------------------------------------

shared("A7_label_count", "SELECT u.user_id, count(CASE WHEN e.event_type = 'click' THEN 1 END) AS clicks FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN events e ON e.user_id = u.user_id GROUP BY u.user_id", "events")
shared("A18_quality_crosstab", "SELECT coalesce(d.lang, 'all') AS lang, coalesce(CAST(l.quality AS STRING), 'all') AS quality, count(*) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY CUBE (d.lang, l.quality)", "documents labels")
shared("A19_conditional_having", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_returnflag = 'R') >= 2 AND count(*) FILTER (WHERE l_quantity > 40) >= 1", "lineitem")
shared("A22_majority_vote", "WITH v AS (SELECT user_id, event_type, count(*) AS c, min(event_id) AS first FROM events GROUP BY user_id, event_type), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, first) AS k FROM v) SELECT user_id, event_type AS vote, c FROM r WHERE k = 1", "events")


@query("A23_percentiles", "SELECT event_type, round(median(value), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY event_type")
def percentiles(t: Tables) -> DataFrame:
    p = lambda q: F.round(F.expr(f"percentile(value, {q})"), 4)
    return t.events.groupBy("event_type").agg(p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"))


shared("A24_top_values", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10", "part")
shared("A25_dedup_rate", "SELECT coalesce(source, 'total') AS source, round(avg(CAST(CASE WHEN c > 1 THEN 1 ELSE 0 END AS DOUBLE)), 6) AS rate FROM (SELECT source, count(*) OVER (PARTITION BY md5(text)) AS c FROM documents) x GROUP BY ROLLUP (source)", "documents")
shared("A26_distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer", "customer")
shared("SO1_SO4_guarded_union", "WITH u AS (SELECT doc_id, 'l' AS f FROM labels UNION ALL SELECT page_id, 'p' FROM pages), d AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id) SELECT doc_id, n > 1 AS twice FROM d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = d.doc_id)", "labels pages benchmark")
shared("SO5_ordered_distinct", "SELECT event_type, min(event_id) AS pos FROM events GROUP BY event_type", "events")
