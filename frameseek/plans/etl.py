"""The master build and its side outputs, and queries that go through files: matrices, submissions, logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameseek.operators import master
from frameseek.operators.staging import dropped, folder, staged
from frameseek.plans.fusion import LISTS, RRF, fused
from frameseek.plans.registry import Tables, query
from frameseek.sources import blobs, files, matrices, storage, submission
from frameseek.streaming import logs


def _place(t: Tables, name: str) -> str:
    """A folder of its own in the shared one; who makes it removes it."""
    return f"{folder(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- S4, S5: documents as frames, pages as images, by source ----------------------------------------------------------

ASSETS = """n AS (SELECT source AS video_id, count(*) AS c, count(DISTINCT lang) AS langs, TRY_CAST(substr(source, 4) AS INTEGER) AS k FROM documents WHERE source IS NOT NULL GROUP BY source),
videos AS (SELECT video_id FROM n UNION SELECT 'src' || CAST(page_id % 25 AS VARCHAR) FROM pages),
headers AS (SELECT video_id, CASE WHEN k % 5 = 3 THEN ['n', 'pts_time', 'frame_idx'] ELSE ['n', 'pts_time', 'fps', 'frame_idx'] END AS cols FROM n),
images AS (SELECT 'src' || CAST(page_id % 25 AS VARCHAR) AS video_id, lpad(CAST(page_id AS VARCHAR), 6, '0') || '.jpg' AS kf_name, url AS kf_path FROM pages WHERE NOT contains(url, '?')),
vectors AS (SELECT video_id, CASE WHEN k % 2 = 0 THEN c ELSE langs END AS rows, CASE WHEN k % 3 = 0 THEN 64 ELSE 512 END AS width FROM n WHERE k % 7 <> 1),
meta AS (SELECT 'src' || CAST(item_id AS VARCHAR) AS video_id, text AS title, length(text) AS len FROM benchmark)"""


def assets(t: Tables) -> dict[str, DataFrame]:
    video = F.concat(F.lit("src"), (F.col("page_id") % 25).cast("string")).alias("video_id")
    docs = t.documents.where("source is not null").select(F.col("source").alias("video_id"), "doc_id", "lang")
    n = docs.groupBy("video_id").agg(F.count(F.lit(1)).alias("c"), F.countDistinct("lang").alias("langs")).withColumn("k", F.expr("try_cast(substr(video_id, 4) as int)"))
    every, some = (F.array(*map(F.lit, c)) for c in (("n", "pts_time", "fps", "frame_idx"), ("n", "pts_time", "frame_idx")))
    stem = lambda c, width: F.lpad(F.col(c).cast("string"), F.greatest(F.length(F.col(c).cast("string")), F.lit(width)), F.lit("0"))
    seen = t.labels.select("doc_id").distinct()
    found = docs.join(seen, "doc_id").select("video_id", stem("doc_id", 3).alias("stem")).union(t.pages.where("page_id % 2 = 0").select(video, stem("page_id", 6))).distinct()
    return {
        "videos": n.select("video_id").union(t.pages.select(video)).distinct().withColumn("video_path", F.concat("video_id", F.lit(".mp4"))),
        "frames": docs.select("video_id", F.col("doc_id").alias("n"), F.col("doc_id").cast("double").alias("pts_time"), F.lit(25.0).alias("fps"), (F.col("doc_id") * 25).alias("frame_idx")),
        "headers": n.select("video_id", F.when(F.col("k") % 5 == 3, some).otherwise(every).alias("columns")),
        "images": t.pages.select(video, F.concat(stem("page_id", 6), F.when(F.col("url").contains("?"), ".txt").otherwise(".jpg")).alias("name"), F.col("url").alias("path")),
        "vectors": n.where("k % 7 <> 1").select("video_id", F.when(F.col("k") % 2 == 0, F.col("c")).otherwise(F.col("langs")).alias("rows"), F.when(F.col("k") % 3 == 0, 64).otherwise(512).alias("width")),
        "meta": t.benchmark.select(F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("video_id"), F.col("text").alias("title"), F.lit(None).cast("string").alias("description"), F.slice(F.split("text", " "), 1, 2).alias("keywords"), F.length("text").alias("length"), F.lit(None).cast("string").alias("publish_date")),
        "objects": found.withColumn("path", F.concat(F.lit("o/"), "stem")),
    }


S4_SQL = f"""WITH {ASSETS}, ok AS (SELECT video_id, c FROM headers JOIN n USING (video_id) WHERE len(cols) = 4),
f AS (SELECT ok.video_id, d.doc_id, row_number() OVER (ORDER BY ok.video_id, d.doc_id) - 1 AS row_id, row_number() OVER (PARTITION BY ok.video_id ORDER BY d.doc_id) AS place FROM documents d JOIN ok ON ok.video_id = d.source),
i AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY kf_name) AS place FROM images),
o AS (SELECT DISTINCT source AS video_id, lpad(CAST(doc_id AS VARCHAR), CAST(greatest(3, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS stem FROM documents JOIN labels USING (doc_id) UNION SELECT 'src' || CAST(page_id % 25 AS VARCHAR), lpad(CAST(page_id AS VARCHAR), 6, '0') FROM pages WHERE page_id % 2 = 0),
x AS (SELECT f.*, i.kf_name, i.kf_path, coalesce(replace(i.kf_name, '.jpg', ''), lpad(CAST(doc_id AS VARCHAR), CAST(greatest(3, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0')) AS stem FROM f LEFT JOIN i USING (video_id, place))
SELECT x.row_id, x.video_id, doc_id AS kf_n, kf_name, doc_id * 25 AS frame_idx, kf_path, CASE WHEN o.stem IS NOT NULL THEN 'o/' || x.stem END AS obj_path, x.video_id || '.mp4' AS video_path,
  coalesce(v.rows = n.c AND v.width = 512, false) AS has_clip, coalesce(title, '') AS title, coalesce(array_to_string(string_split(title, ' ')[1:2], ' '), '') AS keywords, len AS video_length
FROM x JOIN n USING (video_id) LEFT JOIN o ON o.video_id = x.video_id AND o.stem = x.stem LEFT JOIN vectors v ON v.video_id = x.video_id LEFT JOIN meta ON meta.video_id = x.video_id"""


@query("S4_master_build", S4_SQL)
def master_build(t: Tables) -> DataFrame:
    rows, _, _ = master.build(**assets(t))
    return rows.select("row_id", "video_id", "kf_n", "kf_name", "frame_idx", "kf_path", "obj_path", "video_path", "has_clip", "title", "keywords", F.col("video_length").cast("long").alias("video_length"))


S5_SQL = f"""WITH {ASSETS}, i AS (SELECT video_id, count(*) AS images FROM images GROUP BY video_id),
s AS (SELECT videos.video_id, cols, coalesce(c, 0) AS frames, coalesce(images, 0) AS images, v.rows, v.width, title IS NOT NULL AS has_meta FROM videos LEFT JOIN headers USING (video_id) LEFT JOIN n USING (video_id) LEFT JOIN i USING (video_id) LEFT JOIN vectors v USING (video_id) LEFT JOIN meta USING (video_id))
SELECT video_id, 'thieu_csv' AS code, '' AS detail FROM s WHERE cols IS NULL
UNION ALL SELECT video_id, 'csv_thieu_cot', array_to_string(cols, ', ') FROM s WHERE len(cols) < 4
UNION ALL SELECT video_id, 'lech_so_keyframe', 'csv=' || frames || ' anh=' || images FROM s WHERE len(cols) = 4 AND images <> frames
UNION ALL SELECT video_id, 'thieu_npy', '' FROM s WHERE len(cols) = 4 AND rows IS NULL
UNION ALL SELECT video_id, 'lech_so_vector', 'csv=' || frames || ' npy=' || rows FROM s WHERE len(cols) = 4 AND rows <> frames
UNION ALL SELECT video_id, 'sai_chieu_vector', '(' || rows || ', ' || width || ')' FROM s WHERE len(cols) = 4 AND rows = frames AND width <> 512
UNION ALL SELECT video_id, 'thieu_metadata', '' FROM s WHERE len(cols) = 4 AND NOT has_meta"""


@query("S5_quality_codes", S5_SQL)
def quality_codes(t: Tables) -> DataFrame:
    return master.build(**assets(t))[1]


# --- S17: paths of today --------------------------------------------------------------------------------------------

S17_CTE = """old AS (SELECT doc_id AS kf_n, source AS video_id, 'old/' || source || '/' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(3, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') || '.jpg' AS kf_path, lpad(CAST(doc_id AS VARCHAR), CAST(greatest(3, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') || '.jpg' AS file, CASE WHEN doc_id % 2 = 0 THEN 'kept.jpg' END AS kf_name, 'old/' || source || '.mp4' AS video_path FROM documents),
l AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), f AS (SELECT source, max(doc_id) AS m FROM documents WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT o.*, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN kf_n % 5 = 0 THEN kf_path ELSE 'new/' || file END END AS image, kf_n % 3 = 0 AND video_id IS NOT NULL AS there, CASE WHEN m % 2 = 0 THEN 'new/' || video_id || '.mp4' END AS film, coalesce(m % 3 = 0, false) AS film_there FROM old o LEFT JOIN l ON l.doc_id = o.kf_n LEFT JOIN f ON f.source = o.video_id)"""


def _patched(t: Tables):
    name = F.concat(F.lpad(F.col("doc_id").cast("string"), F.greatest(F.length(F.col("doc_id").cast("string")), F.lit(3)), F.lit("0")), F.lit(".jpg"))
    docs = t.documents.select("doc_id", "source", name.alias("file"), F.concat(F.lit("old/"), "source", F.lit("/"), name).alias("old"))
    films = docs.where("source is not null").groupBy("source").agg(F.max("doc_id").alias("m"))
    rows = docs.select(F.col("doc_id").alias("kf_n"), F.col("source").alias("video_id"), F.when(F.col("doc_id") % 2 == 0, "kept.jpg").alias("kf_name"), F.col("old").alias("kf_path"), F.concat(F.lit("old/"), "source", F.lit(".mp4")).alias("video_path"))
    good = t.labels.where("quality = 1").select("doc_id").distinct()
    images = docs.join(good, "doc_id", "left_semi").select(F.col("source").alias("video_id"), F.col("file").alias("name"), F.when(F.col("doc_id") % 5 == 0, F.col("old")).otherwise(F.concat(F.lit("new/"), "file")).alias("path"))
    videos = films.where("m % 2 = 0").select(F.col("source").alias("video_id"), F.concat(F.lit("new/"), "source", F.lit(".mp4")).alias("path"))
    there = docs.where("doc_id % 3 = 0").select(F.col("old").alias("path")).union(films.where("m % 3 = 0").select(F.concat(F.lit("old/"), "source", F.lit(".mp4"))))
    return master.patched(rows, images, videos, there)


@query("S17_path_patching", f"WITH {S17_CTE} SELECT kf_n, video_id, CASE WHEN image IS NOT NULL THEN file WHEN there THEN coalesce(kf_name, file) END AS kf_name, coalesce(image, CASE WHEN there THEN kf_path END) AS kf_path, coalesce(film, CASE WHEN film_there THEN video_path END) AS video_path FROM p")
def path_patching(t: Tables) -> DataFrame:
    return _patched(t)[0]


@query("S17_patch_counters", f"WITH {S17_CTE} SELECT CAST(count(*) FILTER (WHERE image <> kf_path) AS BIGINT) AS image_new, count(*) FILTER (WHERE image = kf_path OR (image IS NULL AND there)) AS image_kept, count(*) FILTER (WHERE image IS NULL AND NOT there) AS image_none, count(*) FILTER (WHERE film IS NOT NULL) AS video_new, count(*) FILTER (WHERE film IS NULL AND film_there) AS video_kept, count(*) FILTER (WHERE film IS NULL AND NOT film_there) AS video_none FROM p")
def patch_counters(t: Tables) -> DataFrame:
    """The counters that the patching notes as its rows go by."""
    rows, seen = _patched(t)
    staged(rows)
    names = [f"{k}_{s}" for k in ("image", "video") for s in ("new", "kept", "none")]
    return t.spark.createDataFrame([tuple(seen.get[n] or 0 for n in names)], ", ".join(f"{n} long" for n in names))


# --- S1, S2, S7, S8, S26: files of small tables --------------------------------------------------------------------

VIDEO = "'L' || lpad(CAST(page_id % 30 AS VARCHAR), 2, '0') || '_V' || lpad(CAST(page_id // 30 AS VARCHAR), greatest(3, length(CAST(page_id // 30 AS VARCHAR)))::INTEGER, '0')"
TREE = f"x AS (SELECT {VIDEO} AS video_id, page_id % 5 <> 2 AS csv, page_id % 4 <> 1 AS video, page_id % 7 = 3 AS clip, page_id % 2 = 0 AS keyframe_dir, page_id % 3 <> 0 AS object_dir FROM pages)"


def _videos(t: Tables) -> DataFrame:
    number = F.floor(F.col("page_id") / 30).cast("string")
    name = F.concat(F.lit("L"), F.lpad((F.col("page_id") % 30).cast("string"), 2, "0"), F.lit("_V"), F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0")))
    return t.pages.select("page_id", name.alias("video"))


def _tree(t: Tables) -> str:
    """Files of each page as a video with some of its assets, in folders by kind, and others that are none."""
    v, p = _videos(t), F.col("page_id")
    file = lambda wanted, *path: F.when(wanted, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in path]))
    name = F.col("video")
    paths = [file(p % 5 != 2, "csv/", name, ".csv"), file(p % 4 != 1, "video/", name, ".MP4"), file(p % 7 == 3, "clip/a/", name, ".npy"), file(p % 2 == 0, "keyframes/", name, "/001.jpg"), file(p % 2 == 0, "keyframes/", name, "/002.jpg"), file(p % 3 != 0, "objects/", name, "/001.json"), file(p % 6 == 1, "notes/", name, ".txt"), file(p % 9 == 4, "video/other-", p.cast("string"), ".mp4")]
    place = _place(t, "tree")
    blobs.write(v.select(F.explode(F.filter(F.array(*paths), lambda x: x.isNotNull())).alias("path"), F.lit(b"x").alias("content")), place)
    return place


@query("S1_S2_discovery", f"WITH {TREE} SELECT * FROM x WHERE csv OR video OR clip OR keyframe_dir OR object_dir")
def discovery(t: Tables) -> DataFrame:
    """Which assets each video has, by the files that are there."""
    place = _tree(t)
    found = files.discover(t.spark, place)
    out = staged(found.select("video_id", *[F.col(k).isNotNull().alias(k) for k in sorted(set(files.KINDS.values()))]))
    dropped(found)
    storage.remove(place)
    return out


@query("S2_asset_coverage", f"WITH {TREE} SELECT split_part(video_id, '_', 1) AS grp, count(*) AS videos, count(*) FILTER (WHERE clip) AS clip, count(*) FILTER (WHERE csv) AS csv, count(*) FILTER (WHERE keyframe_dir) AS keyframe_dir, count(*) FILTER (WHERE object_dir) AS object_dir, count(*) FILTER (WHERE video) AS video FROM x WHERE csv OR video OR clip OR keyframe_dir OR object_dir GROUP BY grp")
def asset_coverage(t: Tables) -> DataFrame:
    place = _tree(t)
    found = files.discover(t.spark, place)
    out = staged(files.coverage(found))
    dropped(found)
    storage.remove(place)
    return out


@query("S7_nested_to_long", f"""WITH d AS (SELECT {VIDEO} AS video_id, page_id AS p, unnest(range(page_id % 9 + 1)) AS j FROM pages WHERE page_id % 11 <> 5),
s AS (SELECT *, (95 - 10 * CASE WHEN p % 7 = 0 AND j < 2 THEN 7 - j ELSE j END) / 100.0::DOUBLE AS score FROM d), c AS (SELECT *, min(CASE WHEN score < 0.4 THEN j END) OVER (PARTITION BY p) AS stop FROM s)
SELECT video_id, j AS pos, CASE WHEN p % 3 <> 0 OR j < p % 9 THEN 'thing ' || j END AS label, score, CASE WHEN p % 4 <> 3 THEN j + 0.5::DOUBLE END AS bottom FROM c WHERE stop IS NULL OR j < stop""")
def nested(t: Tables) -> DataFrame:
    """Detection files of the pages to rows: parallel arrays, some too short, some files cut, some scores out of order."""
    v, p = _videos(t), F.col("page_id")
    js = F.sequence(F.lit(0).cast("long"), p % 9)
    odd = lambda j: F.when((p % 7 == 0) & (j < 2), 7 - j).otherwise(j)
    scores = F.transform(js, lambda j: (95 - 10 * odd(j)) / F.lit(100.0))
    names = F.transform(F.when(p % 3 == 0, F.slice(js, F.lit(1), (p % 9).cast("int"))).otherwise(js), lambda j: F.concat(F.lit("thing "), j.cast("string")))
    boxes = F.when(p % 4 != 3, F.transform(js, lambda j: F.array(j.cast("double"), j.cast("double"), j + F.lit(0.5), j + F.lit(1.0))))
    text = F.to_json(F.struct(scores.alias("detection_scores"), names.alias("detection_class_entities"), boxes.alias("detection_boxes")))
    place = _place(t, "detections")
    blobs.write(v.select(F.concat("video", F.lit("/001.json")).alias("path"), F.when(p % 11 == 5, F.substring(text, 1, 30)).otherwise(text).alias("content")), place)
    rows = files.detections(t.spark, place, 0.4)
    out = staged(rows.select(F.regexp_extract("path", files.VIDEO_ID, 1).alias("video_id"), F.col("pos").cast("long").alias("pos"), "label", "score", F.get("box", F.lit(2)).alias("bottom")))
    storage.remove(place)
    return out


@query("S26_query_folder", "SELECT 'query-p1-' || item_id || CASE item_id % 3 WHEN 0 THEN '-kis' WHEN 1 THEN '-qa' ELSE '-trake' END || '.txt' AS name, CASE item_id % 3 WHEN 0 THEN 'kis' WHEN 1 THEN 'qa' ELSE 'trake' END AS kind, md5(text || chr(10) || 'E1 ' || text) AS digest FROM benchmark WHERE item_id % 10 <> 9")
def query_folder(t: Tables) -> DataFrame:
    """The items as question files and read back; files of other names are no questions."""
    i = F.col("item_id")
    kind = F.when(i % 3 == 0, "-kis").when(i % 3 == 1, "-qa").otherwise("-trake")
    name = F.when(i % 10 == 9, F.concat(F.lit("notes-"), i.cast("string"), F.lit(".txt"))).otherwise(F.concat(F.lit("query-p1-"), i.cast("string"), kind, F.lit(".txt")))
    place = _place(t, "questions")
    blobs.write(t.benchmark.select(name.alias("path"), F.concat("text", F.lit("\nE1 "), "text").alias("content")), place)
    out = staged(files.query_folder(t.spark, place).select("name", "kind", F.md5("text").alias("digest")))
    storage.remove(place)
    return out


# --- S11: matrices --------------------------------------------------------------------------------------------------

GRID = "list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT))"


@query("S11_matrix_files", f"SELECT vec_id, len(embedding) AS width, md5(array_to_string({GRID}, ',')) AS digest FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL")
def matrix_files(t: Tables) -> DataFrame:
    """Vectors through archives of matrices and back: written by tasks, read by ranges of rows, the two members joined by place."""
    place = _place(t, "matrices")
    matrices.write(t.embeddings.where("vec_id is not null and embedding is not null").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v")), place)
    ids, vectors = matrices.read(t.spark, place, "row_id"), matrices.read(t.spark, place, "vec")
    both = ids.withColumnRenamed("v", "vec_id").join(vectors, ["file", "pos"])
    grid = F.transform("v", lambda x: F.floor(1024 * x.cast("double")).cast("string"))
    back = staged(both.select("vec_id", F.size("v").cast("long").alias("width"), F.md5(F.array_join(grid, ",")).alias("digest")))
    storage.remove(place)
    return back


# --- S23, S25, E14: submissions -------------------------------------------------------------------------------------

ANSWERS = f"""{LISTS}, {RRF}, a AS (SELECT 'query-p1-' || qid || '-kis' AS name, rank, 'V_' || video_id AS video_id, [row_id] AS frames, NULL AS answer FROM fused WHERE rank <= 100
  UNION ALL SELECT 'query-p1-' || qid || '-qa', rank, 'V_' || video_id, [row_id], 'say "' || row_id || '", ' || qid || chr(10) || 'end' FROM fused WHERE rank <= 100
  UNION ALL SELECT 'query-p1-' || qid || '-trake', rank, 'V_' || video_id, [row_id, row_id, row_id + rank], NULL FROM fused WHERE rank <= 100)"""


def _answers(t: Tables) -> DataFrame:
    f = fused(t).where("rank <= 100").withColumn("video", F.concat(F.lit("V_"), F.col("video_id").cast("string")))
    say = F.concat(F.lit('say "'), F.col("row_id").cast("string"), F.lit('", '), "qid", F.lit("\nend"))
    kinds = {"kis": (F.array("row_id"), F.lit(None).cast("string")), "qa": (F.array("row_id"), say), "trake": (F.array(F.col("row_id"), F.col("row_id"), F.col("row_id") + F.col("rank")), F.lit(None).cast("string"))}
    one = lambda k: f.select(F.concat(F.lit("query-p1-"), "qid", F.lit(f"-{k}")).alias("name"), "rank", F.col("video").alias("video_id"), kinds[k][0].alias("frames"), kinds[k][1].alias("answer"))
    return one("kis").union(one("qa")).union(one("trake"))


@query("S23_S25_submission_round_trip", f"WITH {ANSWERS} SELECT name, rank, video_id, array_to_string(frames, ' ') AS frames, answer FROM a")
def submission_round_trip(t: Tables) -> DataFrame:
    """Answers of the three kinds through the sink and back, typed by their files' names."""
    place, rows = _place(t, "submission"), staged(_answers(t))
    submission.write(rows, place, rows.where("name like '%trake'").select("name", F.lit(3).alias("events")).distinct())
    back = submission.read(t.spark, place)
    back = staged(back.select("name", "rank", "video_id", F.array_join(F.transform("frames", lambda x: x.cast("string")), " ").alias("frames"), "answer"))
    storage.remove(place)
    return back


# Orders as answers with faults: a name by customer, a video, frames and an answer by key.
FAULTY = """o AS (SELECT *, o_orderkey AS k, o_custkey % 40 AS c FROM orders), r AS (SELECT 'query-' || c || CASE WHEN c % 8 = 7 THEN '-vqa' WHEN c % 3 = 0 THEN '-kis' WHEN c % 3 = 1 THEN '-qa' ELSE '-trake' END AS name, CASE WHEN c % 8 = 7 THEN '' WHEN c % 3 = 0 THEN 'kis' WHEN c % 3 = 1 THEN 'qa' ELSE 'trake' END AS kind, k % 1000 AS rank,
  CASE k % 11 WHEN 0 THEN 'L1_V' || k % 17 || '.MP4' WHEN 1 THEN 'L1 V' || k % 17 ELSE 'L1_V' || k % 17 END AS video_id,
  CASE WHEN c % 3 = 2 OR k % 29 = 0 THEN CASE k % 5 WHEN 0 THEN [k % 70, k % 60] ELSE [k % 7, k % 7 + 7, CASE WHEN k % 13 = 0 THEN -1 ELSE 14 + k % 9 END] END ELSE [CASE WHEN k % 13 = 0 THEN -k ELSE k % 97 END] END AS frames,
  CASE WHEN c % 3 = 1 OR k % 31 = 0 THEN CASE k % 7 WHEN 0 THEN '  ' WHEN 1 THEN repeat(o_orderpriority, 20) ELSE o_orderpriority END END AS answer FROM o)"""
E14_SQL = f"""WITH {FAULTY}, x AS (SELECT *, len(frames) AS n, CASE kind WHEN 'trake' THEN answer IS NULL WHEN 'qa' THEN len(frames) = 1 AND answer IS NOT NULL ELSE len(frames) = 1 AND answer IS NULL END AS fits FROM r WHERE kind <> ''),
v AS (SELECT DISTINCT name, NULL AS rank, 'name' AS rule FROM r WHERE kind = ''
 UNION ALL SELECT name, rank, 'kind' FROM x WHERE NOT fits
 UNION ALL SELECT name, rank, 'suffix' FROM x WHERE fits AND lower(video_id) LIKE '%.mp4'
 UNION ALL SELECT name, rank, 'video' FROM x WHERE fits AND lower(video_id) NOT LIKE '%.mp4' AND NOT regexp_full_match(video_id, '[A-Za-z0-9_]+')
 UNION ALL SELECT name, rank, 'frame' FROM x WHERE fits AND list_min(frames) < 0
 UNION ALL SELECT name, rank, 'blank' FROM x WHERE fits AND kind = 'qa' AND trim(answer) = ''
 UNION ALL SELECT name, rank, 'long' FROM x WHERE fits AND kind = 'qa' AND length(answer) > 100
 UNION ALL SELECT name, rank, 'events' FROM x WHERE fits AND kind = 'trake' AND n <> 3
 UNION ALL SELECT name, rank, 'order' FROM x WHERE fits AND kind = 'trake' AND list_sort(frames) <> frames
 UNION ALL SELECT name, NULL, 'rows' FROM x GROUP BY name HAVING count(*) > 100
 UNION ALL SELECT name, NULL, 'lengths' FROM x WHERE fits AND kind = 'trake' GROUP BY name HAVING count(DISTINCT n) > 1
 UNION ALL SELECT name, max(rank), 'twice' FROM x GROUP BY name, video_id, frames, answer HAVING count(*) > 1)
SELECT name, rule, count(*) AS n, max(rank) AS last FROM v GROUP BY name, rule"""


def faulty(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 40
    end = F.when(c % 8 == 7, "-vqa").when(c % 3 == 0, "-kis").when(c % 3 == 1, "-qa").otherwise("-trake")
    number = (k % 17).cast("string")
    video = F.when(k % 11 == 0, F.concat(F.lit("L1_V"), number, F.lit(".MP4"))).when(k % 11 == 1, F.concat(F.lit("L1 V"), number)).otherwise(F.concat(F.lit("L1_V"), number))
    chain = F.when(k % 5 == 0, F.array(k % 70, k % 60)).otherwise(F.array(k % 7, k % 7 + 7, F.when(k % 13 == 0, F.lit(-1).cast("long")).otherwise(14 + k % 9)))
    frames = F.when((c % 3 == 2) | (k % 29 == 0), chain).otherwise(F.array(F.when(k % 13 == 0, -k).otherwise(k % 97)))
    said = F.when(k % 7 == 0, "  ").when(k % 7 == 1, F.repeat("o_orderpriority", 20)).otherwise(F.col("o_orderpriority"))
    return t.orders.select(F.concat(F.lit("query-"), c.cast("string"), end).alias("name"), (k % 1000).cast("int").alias("rank"), video.alias("video_id"), frames.alias("frames"), F.when((c % 3 == 1) | (k % 31 == 0), said).alias("answer"))


@query("E14_submission_rules", E14_SQL)
def submission_rules(t: Tables) -> DataFrame:
    """Every rule that orders made into answers break, by file."""
    rows = faulty(t)
    wrong = submission.violations(rows, rows.select("name", F.lit(3).alias("events")).distinct())
    return wrong.groupBy("name", "rule").agg(F.count(F.lit(1)).alias("n"), F.max("rank").cast("long").alias("last"))


# --- S12: logs ------------------------------------------------------------------------------------------------------


@query("S12_log_stream", "SELECT * FROM (SELECT user_id, arg_max(CASE WHEN event_id % 10 = 9 THEN ' ' ELSE event_type END, event_id) AS said FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND event_id % 7 <> 3 GROUP BY user_id) WHERE trim(said) <> ''")
def log_stream(t: Tables) -> DataFrame:
    """Events as logs, a file for each stretch of ids, followed as a stream in several batches; some lines are cut, some are blank."""
    place = _place(t, "logs")
    whole = F.to_json(F.struct("user_id", F.when(F.col("event_id") % 10 == 9, " ").otherwise(F.col("event_type")).alias("said")))
    line = F.when(F.col("event_id") % 7 == 3, F.substring(whole, 1, 12)).otherwise(whole)
    events = t.events.where("event_type is not null")
    last = events.agg(F.max("event_id")).first()[0] or 0
    for c in range(4):  # later quarters are later files; a user's lines of a quarter are in one
        some = events.where(F.floor(F.col("event_id") * 4 / (last + 1)) == c).repartition("user_id").sortWithinPartitions("event_id")
        some.select(line.alias("value")).write.mode("append").text(f"{place}/in")
    logs.follow(t.spark, f"{place}/in", f"{place}/out", f"{place}/checkpoint", "user_id", "said", 8).awaitTermination()
    back = staged(logs.current(t.spark, f"{place}/out", "user_id", "said"))
    storage.remove(place)
    return back
