"""The master table of frames from what each video has, with problems as a second output of the same build.

Inputs are tables, one a kind of asset: frames (video_id, n, pts_time, fps, frame_idx), the
columns that each video's frame file has, images, shapes of vector files, metadata and detection files.
Frames and images are zipped by position; detections are joined by the image's name, or by the
frame's number where there is no image.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from frameseek.operators.numbering import placed
from frameseek.operators.staging import staged

# The columns a frame file needs, what counts as an image, and the codes of what is wrong with a video.
NEEDED = ("n", "pts_time", "fps", "frame_idx")
IMAGES = r"(?i)\.(jpg|jpeg|png)$"
CODES = ("thieu_csv", "csv_thieu_cot", "lech_so_keyframe", "lech_so_vector", "sai_chieu_vector", "thieu_npy", "thieu_metadata")


def problems_of(videos: DataFrame, width: int) -> DataFrame:
    """(video_id, code, detail), a row a problem; ``videos``: video_id, columns, frames, images, vectors, vector_width, has_meta.

    A video without a frame file, or whose file lacks a column, has that problem alone. Of its vectors a wrong
    number is told before a wrong width.
    """
    lacking = ~F.forall(F.array(*map(F.lit, NEEDED)), lambda c: F.array_contains("columns", c))
    say = lambda code, *detail: F.struct(F.lit(code).alias("code"), F.concat(*[F.lit(d) if isinstance(d, str) else d.cast("string") for d in detail]).alias("detail"))
    c = dict(zip(("no_file", "columns", "images", "vectors", "width", "no_vectors", "no_meta"), CODES))
    vectors = F.when(F.col("vectors").isNull(), say(c["no_vectors"], "")).when(F.col("vectors") != F.col("frames"), say(c["vectors"], "csv=", F.col("frames"), " npy=", F.col("vectors"))).when(F.col("vector_width") != width, say(c["width"], "(", F.col("vectors"), ", ", F.col("vector_width"), ")"))
    several = F.array(F.when(F.col("images") != F.col("frames"), say(c["images"], "csv=", F.col("frames"), " anh=", F.col("images"))), vectors, F.when(~F.col("has_meta"), say(c["no_meta"], "")))
    found = F.when(F.col("columns").isNull(), F.array(say(c["no_file"], ""))).when(lacking, F.array(say(c["columns"], F.array_join("columns", ", ")))).otherwise(F.filter(several, lambda x: x.isNotNull()))
    return videos.select("video_id", F.explode(found).alias("p")).select("video_id", "p.code", "p.detail")


def _per_video(videos: DataFrame, frames: DataFrame, headers: DataFrame, images: DataFrame, vectors: DataFrame, meta: DataFrame) -> DataFrame:
    count = lambda d, name: d.groupBy("video_id").agg(F.count(F.lit(1)).alias(name))
    sides = [headers.select("video_id", "columns"), count(frames, "frames"), count(images, "images"), vectors.select("video_id", F.col("rows").alias("vectors"), F.col("width").alias("vector_width")), meta.select("video_id", F.lit(True).alias("has_meta"))]
    both = reduce(lambda a, b: a.join(b, "video_id", "left"), sides, videos.select("video_id"))
    return both.withColumns({x: F.coalesce(x, F.lit(0).cast("long")) for x in ("frames", "images")} | {"has_meta": F.coalesce("has_meta", F.lit(False))})


def build(videos: DataFrame, frames: DataFrame, headers: DataFrame, images: DataFrame, vectors: DataFrame, meta: DataFrame, objects: DataFrame, width: int = 512) -> tuple[DataFrame, DataFrame, Observation]:
    """The master table, the problems, and counters that hold once the master table has been computed.

    ``videos``: video_id, video_path; ``frames``: video_id and NEEDED; ``headers``: video_id, columns; ``images``:
    video_id, name, path; ``vectors``: video_id, rows, width; ``meta``: video_id, title, description, keywords, length,
    publish_date; ``objects``: video_id, stem, path. One row a video in videos, headers, vectors and meta.
    Rows are numbered by video and n. Videos with no usable frame file have no rows. Null ids take no part.
    """
    known = videos.where("video_id is not null")
    images = images.where(F.col("name").rlike(IMAGES))
    state = staged(_per_video(known, frames, headers, images, vectors, meta))
    problems = problems_of(state, width)
    usable = state.where(F.forall(F.array(*map(F.lit, NEEDED)), lambda c: F.array_contains("columns", c)))
    rows = placed(frames.join(usable.select("video_id", ((F.col("vectors") == F.col("frames")) & (F.col("vector_width") == width)).alias("fits")), "video_id"), "video_id", [F.asc("n")], "place")
    shots = placed(images.join(usable.select("video_id"), "video_id", "left_semi").select("video_id", F.col("name").alias("kf_name"), F.col("path").alias("kf_path")), "video_id", [F.asc("kf_name")], "place", "_i").drop("_i")
    both = rows.join(shots, ["video_id", "place"], "left")
    stem = F.coalesce(F.regexp_replace("kf_name", r"\.[^.]*$", ""), F.lpad(F.col("n").cast("string"), F.greatest(F.length(F.col("n").cast("string")), F.lit(3)), F.lit("0")))
    both = both.withColumn("stem", stem).join(objects.select("video_id", "stem", F.col("path").alias("obj_path")), ["video_id", "stem"], "left")
    both = both.join(known, "video_id", "left").join(meta, "video_id", "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    master = both.select("row_id", "video_id", F.col("n").alias("kf_n"), "kf_name", "frame_idx", "pts_time", "fps", "kf_path", "obj_path", "video_path", F.coalesce("fits", F.lit(False)).alias("has_clip"), text("title"), text("description"), F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " ").alias("keywords"), F.col("length").alias("video_length"), text("publish_date"))
    seen = Observation()
    counters = {"rows": F.lit(1), "with_image": F.col("kf_name").isNotNull(), "with_objects": F.col("obj_path").isNotNull(), "with_vector": F.col("has_clip")}
    return master.observe(seen, *[F.sum(c.cast("long")).alias(k) for k, c in counters.items()]), problems, seen


def patched(master: DataFrame, images: DataFrame, videos: DataFrame, existing: DataFrame) -> tuple[DataFrame, Observation]:
    """``master`` with paths of today, and counters: new, kept and lacking images and videos.

    A frame takes the image of its number that is listed now; else its old path, if that still exists; else none,
    and no name either. Likewise a video its file. ``images``: video_id, name, path; ``videos``: video_id, path, one
    row each; ``existing``: path of everything that is there. The other columns stay.
    """
    name = F.concat(F.lpad(F.col("kf_n").cast("string"), F.greatest(F.length(F.col("kf_n").cast("string")), F.lit(3)), F.lit("0")), F.lit(".jpg"))
    there = existing.select("path").where("path is not null").distinct()
    now = images.groupBy("video_id", F.col("name").alias("_name")).agg(F.min("path").alias("_image"))
    files = videos.groupBy("video_id").agg(F.min("path").alias("_video"))
    old = lambda side: there.select(F.col("path").alias(side), F.lit(True).alias(f"_{side}_there"))
    m = master.withColumn("_name", name).join(now, ["video_id", "_name"], "left").join(files, "video_id", "left").join(old("kf_path"), "kf_path", "left").join(old("video_path"), "video_path", "left")

    def state(new: str, old: str) -> Column:
        return F.when(F.col(new).isNotNull(), F.when(F.col(new).eqNullSafe(F.col(old)), "kept").otherwise("new")).when(F.col(f"_{old}_there"), "kept").otherwise("none")

    m = m.withColumns({"_i": state("_image", "kf_path"), "_v": state("_video", "video_path")})
    keep = F.when(F.col("_kf_path_there"), F.coalesce("kf_name", "_name"))
    path = lambda new, old: F.coalesce(new, F.when(F.col(f"_{old}_there"), F.col(old)))
    seen = Observation()
    m = m.observe(seen, *[F.sum((F.col(c) == s).cast("long")).alias(f"{k}_{s}") for c, k in (("_i", "image"), ("_v", "video")) for s in ("new", "kept", "none")])
    done = {"kf_name": F.when(F.col("_image").isNotNull(), F.col("_name")).otherwise(keep), "kf_path": path("_image", "kf_path"), "video_path": path("_video", "video_path")}
    return m.select(*[done.get(c, F.col(c)).alias(c) for c in master.columns]), seen
