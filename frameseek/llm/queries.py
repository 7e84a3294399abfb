"""The driver's queries of the training-data operators, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameseek.llm import bpe, decontaminate, fingerprints, langid, lm, mixing, neardup, pii, quality, resample, topk, treaps, warc
from frameseek.llm.common import crc_bucket, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket("doc_id", 5) == 0
    model = langid.train(docs, ~held_out)
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket("doc_id", 3) == 1
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality.score(docs.select("doc_id", "text", held_out.alias("held_out")), model)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_bucket("doc_id", 5) != 1).alias("train"))
    found = lm.score(docs, "train")
    return found.select("doc_id", (~F.col("flag")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treaps.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS no
  FROM d GROUP BY source
), w AS (
  SELECT *, CAST([3, 1, 2][CAST(no % 3 AS INTEGER) + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(weight) OVER ()
             - coalesce(sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w
), t AS (
  SELECT source, source_size, least(cap, max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight) AS target FROM l
), z AS (
  SELECT *, CAST(ceil(least(want, source_size) / 64.0) + ceil(greatest(want - source_size, 0) / 64.0) AS BIGINT) AS slots, CAST(ceil(source_size / 64.0) AS BIGINT) AS blocks
  FROM (SELECT *, CAST(round(target) AS BIGINT) AS want FROM t)
), o AS (
  SELECT *, CAST(sum(slots) OVER (ORDER BY source IS NULL, source) AS BIGINT) AS hi FROM z
), n AS (
  SELECT n, greatest(1, CAST(round(n * 2 / (1 + sqrt(5.0::DOUBLE))) AS BIGINT)) AS near FROM (SELECT CAST(coalesce(sum(slots), 0) AS BIGINT) AS n FROM z)
), g AS (
  SELECT n, g FROM (SELECT n, d, unnest([near + d, near - d]) AS g, near FROM n, range(1000) r(d)) WHERE g > 0 AND gcd(g, n) = 1 ORDER BY d, g < near LIMIT 1
), i AS (
  SELECT slot, (slot * g) % n AS point FROM (SELECT unnest(range(n)) AS slot, g, n FROM g)
), k AS (
  SELECT o.source, o.want, o.source_size, o.blocks, i.slot, row_number() OVER (PARTITION BY o.source ORDER BY i.slot) - 1 AS rank
  FROM i JOIN o ON i.point >= o.hi - o.slots AND i.point < o.hi
), u AS (
  SELECT source, slot, rank % blocks AS block, least((rank % blocks + 1) * 64, source_size, want - (rank // blocks) * source_size) AS until FROM k
), p AS (
  SELECT d.doc_id, d.h, d.size, d.source, t.source_size, t.target,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT h, source, a, greatest(a, block * 64) AS lo, least(a + size, (block + 1) * 64) AS hi, block
  FROM (SELECT *, unnest(range(a // 64, (a + size - 1) // 64 + 1)) AS block FROM p WHERE size > 0)
), x AS (
  SELECT c.h, c.source, c.a, sum(greatest(least(c.hi, u.until) - c.lo, 0)) AS taken, min(u.slot) FILTER (WHERE least(c.hi, u.until) > c.lo) AS first_slot
  FROM c JOIN u ON c.source IS NOT DISTINCT FROM u.source AND c.block = u.block GROUP BY ALL
)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(coalesce(x.taken, 0) AS BIGINT) AS taken, x.first_slot
FROM p LEFT JOIN x ON p.h = x.h AND p.a = x.a AND p.source IS NOT DISTINCT FROM x.source AND p.size > 0
"""

OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages
), f AS (
  SELECT sha, min(page_id) AS first FROM p GROUP BY sha
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((CAST('0x' || substr(sha, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p JOIN f USING (sha)
"""

OP12_SQL = r"""
WITH d AS (
  SELECT r, doc_id, len(w) AS n, w
  FROM (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents)
  WHERE len(w) > 0
), a AS (
  SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d
), p AS (
  SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term
), q AS (
  SELECT item_id, term, CAST(count(*) AS BIGINT) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, a GROUP BY term, n_docs
), s AS (
  SELECT q.item_id, d.r, d.doc_id, CAST(sum(q.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (100 - 25 + (25 * d.n * a.n_docs) // a.n_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d ON d.r = p.r, a
  GROUP BY q.item_id, d.r, d.doc_id
), k AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0 AND doc_id IS NOT NULL
)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""

OP13_SQL = r"""
WITH i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item, m, array_to_string(w[p : p + m - 1], ' ') AS k
  FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM (SELECT *, least(10, len(w)) AS m FROM i WHERE len(w) > 0))
), d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), o AS (
  SELECT x.r, x.p, x.m, win.item
  FROM (SELECT r, p, m, array_to_string(w[p : p + m - 1], ' ') AS k
        FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)) x
  JOIN win ON x.m = win.m AND x.k = win.k
), h AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS q FROM o) GROUP BY r
), t AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM o) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_language_id, op2_fingerprints, op3_bpe, op4_quality, op5_pii, op6_lm_score, op7_neardup, op8_topk, op9_mixing, op10_warc, op11_resample, op12_ranked_search, op13_decontaminate)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op8_topk": OP8_SQL, "op9_mixing": OP9_SQL, "op10_warc": OP10_SQL, "op12_ranked_search": OP12_SQL, "op13_decontaminate": OP13_SQL}
