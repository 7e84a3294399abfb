"""Text operators over documents, benchmark, pages and conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameseek.functions import text as tx
from frameseek.operators import sequences as sq
from frameseek.plans.registry import Tables, query, shared


@query("T1_fold_full", "SELECT doc_id, md5(replace(strip_accents(lower(trim(text))), 'đ', 'd')) AS folded FROM documents")
def fold_full(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(tx.fold_full(F.col("text"))).alias("folded"))


@query("T2_fold_marks", "SELECT doc_id, md5(strip_accents(lower(text))) AS folded FROM documents")
def fold_marks(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(tx.fold_marks(F.col("text"))).alias("folded"))


@query("T3_has_diacritic", "SELECT lang, count(*) AS n, count(*) FILTER (WHERE strip_accents(lower(text)) <> lower(text)) AS marked FROM documents GROUP BY lang")
def has_diacritic(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(tx.has_diacritic(F.col("text"))).alias("marked"))


@query("T4_tokens_bigrams", r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS unigrams, CAST(coalesce(list_sum(list_transform(string_split_regex(lower(text), '[^\p{L}\p{N}_\s]+'), lambda p: greatest(len(regexp_extract_all(p, '[\p{L}\p{N}_]+')) - 1, 0))), 0) AS BIGINT) AS bigrams FROM documents")
def tokens(t: Tables) -> DataFrame:
    u = F.size(tx.unigrams(F.col("text"))).cast("long")
    return t.documents.select("doc_id", u.alias("unigrams"), (F.size(tx.tokens(F.col("text"))) - u).alias("bigrams"))


@query("T5_link_cleanup", r"SELECT page_id, regexp_replace(url || ' #tag @me x', 'https?://\S+|www\.\S+|#[\p{L}\p{N}_]+|@[\p{L}\p{N}_]+', '. ', 'g') AS clean FROM pages")
def cleanup(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.strip_links(F.concat("url", F.lit(" #tag @me x"))).alias("clean"))


@query("T14_clause_split")
def clause_split(t: Tables) -> DataFrame:
    split = F.udf(sq.split_clauses, "array<string>")
    return t.benchmark.select(F.col("item_id").alias("qid"), F.posexplode(split("text")).alias("pos", "clause"))


@query("T15_question_clause", r"SELECT conv_id, turn, (trim(text) LIKE '%?' OR regexp_matches(lower(text), '^(who|what|when|where|how many)')) AS asks FROM conversations")
def question_clause(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", (F.trim("text").endswith("?") | F.lower("text").rlike("^(who|what|when|where|how many)")).alias("asks"))


@query("T16_event_split")
def event_split(t: Tables) -> DataFrame:
    """The first 40 characters of a text as one event, all others as the next; a line break within an event is a space."""
    split = F.udf(sq.split_events, "array<string>")
    line = F.regexp_replace("text", r"[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]", " ")
    return t.benchmark.select(F.col("item_id").alias("qid"), F.posexplode(split(F.concat(F.lit("E1: "), F.substring(line, 1, 40), F.lit("\nE2: "), F.substring(line, F.lit(41), F.length("text"))))).alias("event", "text"))


@query("T17_clause_routing", r"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 'ocr' WHEN regexp_matches(lower(text), '(says|speaks)') THEN 'asr' ELSE 'visual' END AS channel FROM conversations")
def routing(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.when(F.col("text").rlike("[0-9]{4}"), "ocr").when(F.lower("text").rlike("(says|speaks)"), "asr").otherwise("visual").alias("channel"))


@query("T18_longest_clauses", r"WITH c AS (SELECT item_id AS qid, unnest(list_distinct(list_transform(string_split(text, '.'), lambda x: trim(x)))) AS clause FROM benchmark), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY length(clause) DESC, clause) AS n FROM c WHERE len(string_split(clause, ' ')) >= 3) SELECT qid, clause FROM r WHERE n <= 2")
def longest(t: Tables) -> DataFrame:
    c = t.benchmark.select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(F.transform(F.split("text", r"\."), lambda x: F.trim(x)))).alias("clause")).where(F.size(F.split("clause", " ")) >= 3)
    w = Window.partitionBy("qid").orderBy(F.desc(F.length("clause")), "clause")
    return c.withColumn("n", F.row_number().over(w)).where("n <= 2").select("qid", "clause")


TOK = r"tok AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS token FROM documents), df AS (SELECT token, count(*) AS df FROM tok GROUP BY token), q AS (SELECT item_id AS qid, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS token FROM benchmark)"


def _df(t: Tables) -> DataFrame:
    return t.documents.select(F.explode(F.array_distinct(tx.unigrams(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def _q(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(tx.unigrams(F.col("text")))).alias("token"))


@query("T19_clause_weights", f"WITH {TOK}, w AS (SELECT qid, avg(ln((SELECT count(*) FROM documents) / df)) AS m FROM q JOIN df USING (token) GROUP BY qid) SELECT qid, round(least(greatest(m / (SELECT median(m) FROM w), 0.2), 1.0), 4) AS weight FROM w")
def clause_weights(t: Tables) -> DataFrame:
    n = t.documents.agg(F.count(F.lit(1)).alias("n"))
    w = _q(t).join(_df(t), "token").crossJoin(F.broadcast(n)).groupBy("qid").agg(F.avg(F.log(F.col("n") / F.col("df"))).alias("m"))
    mid = w.agg(F.expr("percentile(m, 0.5)").alias("mid"))
    return w.crossJoin(F.broadcast(mid)).select("qid", F.round(F.least(F.greatest(F.col("m") / F.col("mid"), F.lit(0.2)), F.lit(1.0)), 4).alias("weight"))


@query("T20_anchor_tokens", f"WITH {TOK} SELECT qid, token, df FROM q JOIN df USING (token) WHERE df BETWEEN 1 AND 5")
def anchors(t: Tables) -> DataFrame:
    return _q(t).join(_df(t).where("df between 1 and 5"), "token").select("qid", "token", "df")


@query("F11_phrase_triage", f"WITH {TOK} SELECT i.item_id AS qid, CASE WHEN count(df) < count(q.token) THEN 'missing' WHEN max(df) > 20 THEN 'common' ELSE 'used' END AS bucket FROM benchmark i JOIN q ON q.qid = i.item_id LEFT JOIN df USING (token) GROUP BY i.item_id")
def triage(t: Tables) -> DataFrame:
    j = _q(t).join(_df(t), "token", "left")
    return j.groupBy("qid").agg(F.when(F.count("df") < F.count("token"), "missing").when(F.max("df") > 20, "common").otherwise("used").alias("bucket"))


@query("T21_W11_turn_segments", r"WITH s AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM conversations), l AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM s), j AS (SELECT conv_id, turn, CASE WHEN p IS NULL THEN 1 WHEN len(list_distinct(list_concat(w, p))) = 0 THEN 0 WHEN len(list_intersect(w, p)) / len(list_distinct(list_concat(w, p))) < 0.1 THEN 1 ELSE 0 END AS fresh FROM l) SELECT conv_id, turn, CAST(sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS seg FROM j")
def turn_segments(t: Tables) -> DataFrame:
    """A new segment where consecutive turns share under a tenth of their words."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    s = t.conversations.select("conv_id", "turn", F.array_distinct(tx.unigrams(F.col("text"))).alias("w"))
    s = s.withColumn("p", F.lag("w").over(w)).withColumn("fresh", F.when(F.col("p").isNull() | (tx.jaccard(F.col("w"), F.col("p")) < 0.1), 1).otherwise(0))
    return s.select("conv_id", "turn", F.sum("fresh").over(w).alias("seg"))


@query("T26_phrase_idf", f"WITH {TOK}, p AS (SELECT qid, token, ln((SELECT count(*) FROM documents) / df) AS idf FROM q JOIN df USING (token)), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(idf, 6) DESC, token) AS n FROM p) SELECT qid, token, round(idf, 6) AS idf FROM r WHERE n <= 3")
def phrase_idf(t: Tables) -> DataFrame:
    n = t.documents.agg(F.count(F.lit(1)).alias("n"))
    p = _q(t).join(_df(t), "token").crossJoin(F.broadcast(n)).select("qid", "token", F.round(F.log(F.col("n") / F.col("df")), 6).alias("idf"))
    w = Window.partitionBy("qid").orderBy(F.desc("idf"), "token")
    return p.withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


@query("T28_context_text", "SELECT a.conv_id, a.turn, md5(string_agg(b.text, ' . ' ORDER BY b.turn)) AS around FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 GROUP BY ALL")
def context_text(t: Tables) -> DataFrame:
    a, b = t.conversations.alias("a"), t.conversations.alias("b")
    j = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & F.col("b.turn").between(F.col("a.turn") - 1, F.col("a.turn") + 1))
    parts = F.array_sort(F.collect_list(F.struct("b.turn", "b.text")))
    return j.groupBy("a.conv_id", "a.turn").agg(F.md5(F.array_join(F.transform(parts, lambda x: x["text"]), " . ")).alias("around"))


@query("T29_proper_names", r"SELECT doc_id, len(regexp_extract_all(text, '\p{Lu}[\p{L}]+ \p{Lu}[\p{L}]+')) AS n FROM documents")
def proper_names(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.regexp_count("text", F.lit(r"\p{Lu}[\p{L}]+ \p{Lu}[\p{L}]+")).cast("long").alias("n"))


#: Fixed values of the cleanup: openings that go, at most three of them, and what is trimmed at both ends.
OPENING, ENDS = "^((The|And|Of) ){1,3}", " .,:;\"'"
COUNT = r"^([0-9]+)(?:[^\p{L}\p{N}_]|$)"
CLEANED = rf"""WITH a AS (SELECT doc_id, trim(regexp_replace(split_part(regexp_replace(coalesce(text, ''), '^[ \t\n\f\r]+', ''), chr(10), 1), '[ \t\f\r]+', ' ', 'g')) AS x FROM documents),
b AS (SELECT doc_id, trim(regexp_replace(x, '{OPENING}', ''), ' .,:;"''') AS x FROM a), c AS (SELECT doc_id, x, regexp_extract(x, '{COUNT}', 1) AS n FROM b),
d AS (SELECT doc_id, CASE WHEN n <> '' AND length(x) > length(n) + 12 THEN n ELSE x END AS x FROM c)
SELECT doc_id, CASE WHEN length(x) > 100 THEN trim(coalesce(nullif(regexp_extract(left(x, 100), '^([^\n]*) ', 1), ''), left(x, 100))) ELSE x END AS answer FROM d"""


@query("T30_T31_answer_cleanup", CLEANED)
def answer_cleanup(t: Tables) -> DataFrame:
    """First line, spaces folded, up to three openings and the outer marks dropped; a leading count before a long
    rest stands alone; over 100 characters the cut is at a word. A null text gives an empty answer."""
    line = F.element_at(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"^[ \t\n\f\r]+", ""), "\n"), 1)
    x = F.trim(F.regexp_replace(F.trim(F.regexp_replace(line, r"[ \t\f\r]+", " ")), OPENING, ""), F.lit(ENDS))
    c = t.documents.select("doc_id", x.alias("x")).withColumn("n", F.regexp_extract("x", COUNT, 1))
    c = c.select("doc_id", F.when((F.col("n") != "") & (F.length("x") > F.length("n") + 12), F.col("n")).otherwise(F.col("x")).alias("x"))
    head = F.substring("x", 1, 100)
    cut = F.trim(F.coalesce(F.nullif(F.regexp_extract(head, r"^([^\n]*) ", 1), F.lit("")), head))
    return c.select("doc_id", F.when(F.length("x") > 100, cut).otherwise(F.col("x")).alias("answer"))


@query("T32_last_number", r"SELECT doc_id, regexp_extract_all(text, '[0-9]+')[-1] AS number FROM documents WHERE regexp_matches(text, '[0-9]')")
def last_number(t: Tables) -> DataFrame:
    return t.documents.where(F.col("text").rlike("[0-9]")).select("doc_id", F.element_at(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), -1).alias("number"))


# Number words that answers may write as digits.
NUMBER_WORDS = {"không": "0", "một": "1", "hai": "2", "ba": "3", "bốn": "4", "năm": "5", "sáu": "6", "bảy": "7", "tám": "8", "chín": "9", "mười": "10"}


def plain_answer(c: Column) -> Column:
    """Folded, number words as digits, commas as points, spaces single."""
    out = tx.fold_marks(F.coalesce(c, F.lit("")))
    for word, digit in NUMBER_WORDS.items():
        out = F.regexp_replace(out, rf"(?U)\b{tx.bare(word)}\b", digit)
    return F.trim(F.regexp_replace(F.replace(out, F.lit(","), F.lit(".")), r"(?U)\s+", " "))


def says_all(expected: Column, given: Column) -> Column:
    """Whether every part of the expected answer, between points, semicolons, slashes or 'va', stands in the given one as whole words."""
    parts = F.filter(F.transform(F.split(plain_answer(expected), r"[.;/]| va "), lambda p: F.trim(p)), lambda p: p != "")
    held = plain_answer(given)
    literal = lambda p: F.concat(F.lit(r"(?U)(?<![\w.])\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\w.])"))
    return (F.size(parts) > 0) & F.forall(parts, lambda p: F.regexp_like(held, literal(p)))


_READ = lambda x: f"replace(strip_accents(lower(coalesce({x}, ''))), ',', '.')"
_PLAIN = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))".format
_DIGITS = lambda x: reduce(lambda s, w: rf"regexp_replace(regexp_replace({s}, '(^|[^\p{{L}}\p{{N}}_]){tx.bare(w[0])}($|[^\p{{L}}\p{{N}}_])', '\1{w[1]}\2', 'g'), '(^|[^\p{{L}}\p{{N}}_]){tx.bare(w[0])}($|[^\p{{L}}\p{{N}}_])', '\1{w[1]}\2', 'g')", NUMBER_WORDS.items(), x)
T34_SQL = rf"""WITH a AS (SELECT conv_id, turn, string_split(text, ' ') AS w, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS given FROM conversations),
b AS (SELECT conv_id, turn, {_PLAIN(_DIGITS(_READ("w[1] || CASE turn % 3 WHEN 0 THEN '; ' WHEN 1 THEN ' và ' ELSE ' / ' END || coalesce(w[3], '')")))} AS e, {_PLAIN(_DIGITS(_READ('given')))} AS g FROM a WHERE given IS NOT NULL AND w IS NOT NULL),
p AS (SELECT *, list_filter(list_transform(string_split_regex(e, '[.;/]| va '), lambda x: trim(x)), lambda x: x <> '') AS parts FROM b)
SELECT conv_id, turn, len(parts) > 0 AND len(list_filter(parts, lambda x: NOT regexp_matches(g, '(^|[^\p{{L}}\p{{N}}_.])' || regexp_escape(x) || '($|[^\p{{L}}\p{{N}}_.])'))) = 0 AS ok FROM p"""


@query("T34_answer_parts", T34_SQL)
def answer_parts(t: Tables) -> DataFrame:
    """The first and third word of a turn as an answer of two parts, sought in the next turn."""
    w = F.split("text", " ")
    both = t.conversations.withColumns({"w": w, "given": F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))}).where("given is not null and w is not null")
    between = F.when(F.col("turn") % 3 == 0, "; ").when(F.col("turn") % 3 == 1, " và ").otherwise(" / ")
    expected = F.concat(F.get("w", F.lit(0)), between, F.coalesce(F.get("w", F.lit(2)), F.lit("")))
    return both.select("conv_id", "turn", says_all(expected, F.col("given")).alias("ok"))


RANGE = "[0-9]{1,4}(?:-[0-9]{1,4})?"


@query("T35_range_parsing", f"WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '{RANGE}')) AS part FROM documents), r AS (SELECT doc_id, CAST(split_part(part, '-', 1) AS BIGINT) AS a, CAST(CASE WHEN contains(part, '-') THEN split_part(part, '-', 2) ELSE part END AS BIGINT) AS z FROM p) SELECT doc_id, count(*) FILTER (WHERE z < a) AS backward, CAST(sum(greatest(z - a + 1, 0)) AS BIGINT) AS n, CAST(sum(greatest(z - a + 1, 0) * (a + z) // 2) AS BIGINT) AS total FROM r GROUP BY doc_id")
def ranges(t: Tables) -> DataFrame:
    """Numbers and ranges that a text writes, such as 108-120 and 123, as the number and sum of all their frames; backward ranges are counted."""
    ends = F.transform(F.regexp_extract_all("text", F.lit(RANGE), F.lit(0)), lambda p: F.transform(F.split(p, "-"), lambda x: x.cast("long")))
    d = t.documents.where(F.col("text").rlike("[0-9]")).select("doc_id", F.transform(ends, lambda e: F.struct(e[0].alias("a"), F.element_at(e, -1).alias("z"))).alias("r"))
    d = d.select("doc_id", F.size(F.filter("r", lambda x: x["z"] < x["a"])).cast("long").alias("backward"), F.filter("r", lambda x: x["z"] >= x["a"]).alias("f"))
    sums = lambda of: F.aggregate("f", F.lit(0).cast("long"), lambda s, x: s + of(x["a"], x["z"]))
    return d.select("doc_id", "backward", sums(lambda a, z: z - a + 1).alias("n"), sums(lambda a, z: ((z - a + 1) * (a + z) / 2).cast("long")).alias("total"))


@query("T36_time_format", "SELECT event_id, printf('%02d:%02d:%02d', event_id // 3600, event_id % 3600 // 60, event_id % 60) AS hms FROM events")
def hms(t: Tables) -> DataFrame:
    i = F.col("event_id")
    return t.events.select("event_id", F.format_string("%02d:%02d:%02d", F.floor(i / 3600), F.floor(i % 3600 / 60), i % 60).alias("hms"))


shared("T37_like_search", "SELECT doc_id, source FROM documents WHERE lower(text) LIKE '%benchmark%' OR lower(text) LIKE '%the and%'", "documents")
