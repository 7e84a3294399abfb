"""File sources: query folders, discovery listings, append logs."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameseek.operators.staging import dropped, written
from frameseek.sources import storage

VIDEO_ID = r"(L\d{2}_V\d{3,})"
#: Asset kinds by file extension.
KINDS = {"mp4": "video", "csv": "csv", "json": "object_dir", "npy": "clip", "jpg": "keyframe_dir"}


def _entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """Path and whether it is a folder, of what a folder holds. A local one is read as it goes, another store's in one list."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as some:
            yield from ((e.path, e.is_dir()) for e in some if e.name[0] not in "._")
    else:
        yield from ((i.path, i.type == fs.FileType.Directory) for i in system.get_file_info(fs.FileSelector(folder)) if i.base_name[0] not in "._")


def _listing(uri: str, most: int = 10_000):
    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = storage.at(uri)
        rows = (e for batch in batches for folder in batch.column(0).to_pylist() for e in _entries(system, folder))
        while some := list(islice(rows, most)):
            paths, folders = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(folders, pa.bool_())], names=["path", "folder"])

    return listing


def listed(spark: SparkSession, root: str) -> tuple[DataFrame, list[DataFrame]]:
    """(path) of all files below a folder, and the tables that hold them.

    Tasks list folders, in rounds: each lists what the last one found, so no names are in the driver. Names that begin
    with . or _ are passed over. A store that only Spark reaches, and a pattern of paths, is listed by Spark's driver.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    try:
        system, top = storage.at(uri)
        ours = system.get_file_info(top).type == fs.FileType.Directory
    except (OSError, ValueError, NotImplementedError):
        ours = False
    if not ours:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path"), []
    tables, level = [], spark.createDataFrame([(top,)], "path string")
    while not level.isEmpty():
        tables.append(written(level.mapInArrow(_listing(uri), "path string, folder boolean")))
        level = tables[-1].where("folder").select("path").repartition(spark.sparkContext.defaultParallelism)
    files = tables[0]
    for t in tables[1:]:
        files = files.union(t)
    before = "file:" if isinstance(system, fs.LocalFileSystem) else uri.rstrip("/")
    rest = "path" if isinstance(system, fs.LocalFileSystem) else F.expr(f"substr(path, {len(top.rstrip('/')) + 1})")
    return files.where("not folder").select(F.concat(F.lit(before), rest).alias("path")), tables


def discover(spark: SparkSession, root: str) -> DataFrame:
    """One row a video with one path column for each kind of asset; only names are listed, no content. ``dropped`` takes it away."""
    files, tables = listed(spark, root)
    kind = F.element_at(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p]), F.lower(F.element_at(F.split("path", r"\."), -1)))
    rows = files.select(F.regexp_extract("path", VIDEO_ID, 1).alias("video_id"), kind.alias("kind"), "path").where("video_id <> '' and kind is not null")
    found = written(rows.groupBy("video_id").pivot("kind", sorted(set(KINDS.values()))).agg(F.min("path")))
    dropped(*tables)
    return found


def coverage(assets: DataFrame) -> DataFrame:
    """(grp, videos, a count for each kind) of what ``discover`` found, by the part of the id before the underscore."""
    kinds = sorted(set(KINDS.values()))
    return assets.groupBy(F.substring_index("video_id", "_", 1).alias("grp")).agg(F.count(F.lit(1)).alias("videos"), *[F.count(k).alias(k) for k in kinds])


def detections(spark: SparkSession, folder: str, least: float) -> DataFrame:
    """(path, pos, label, score, box) of the detection files below ``folder``, from the first down to the first score under ``least``.

    Scores are sorted in a sound file, so what follows a low one is not looked at. Labels and boxes that the file
    lacks are null; a file that is no JSON has no rows.
    """
    shape = "detection_scores array<double>, detection_class_entities array<string>, detection_boxes array<array<double>>"
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    d = whole.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", shape, {"mode": "PERMISSIVE"}).alias("d")).select("path", "d.*")
    low = F.array_position(F.transform("detection_scores", lambda s: F.coalesce(s < least, F.lit(True))), True)
    n = F.when(low > 0, low - 1).otherwise(F.size("detection_scores")).cast("int")
    rows = d.where("detection_scores is not null").select("path", "detection_class_entities", "detection_boxes", F.posexplode(F.slice("detection_scores", F.lit(1), n)).alias("pos", "score"))
    return rows.select("path", "pos", F.get("detection_class_entities", "pos").alias("label"), "score", F.get("detection_boxes", "pos").alias("box"))


def query_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(name, kind, text) of files ``query-<batch>-<n>-<kind>.txt``; other names are skipped."""
    rows = spark.read.text(folder, wholetext=True).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"))
    kind = F.regexp_extract("name", r"^query-.+-(kis|qa|trake)\.txt$", 1)
    return rows.select("name", kind.alias("kind"), F.col("value").alias("text")).where("kind <> ''")


def located(lines: DataFrame) -> DataFrame:
    """A text scan, batch or stream, with where each line comes from: ``value`` and ``m``."""
    return lines.select("value", F.struct(*[F.col(f"_metadata.{c}").alias(c) for c in ("file_modification_time", "file_path", "file_block_start")]).alias("m"))


def log_lines(lines: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, at) of the lines of JSON logs that are whole; ``at`` orders them: file by change and name, block, line.

    ``lines`` is what ``located`` gives. Within a file lines are ordered by the start of their block, and
    within a block by the reader's count, however Spark packs blocks into tasks. A line without the value has ''.
    """
    at = F.struct("m.*", F.monotonically_increasing_id().alias("line"))
    rows = lines.select("value", at.alias("at")).select(F.from_json("value", f"{key} long, {value} string", {"mode": "PERMISSIVE"}).alias("r"), "at")
    return rows.where(F.col(f"r.{key}").isNotNull()).select(F.col(f"r.{key}").alias(key), F.coalesce(f"r.{value}", F.lit("")).alias(value), "at")


def last_wins(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, "at").alias(value), F.max("at").alias("at"))


def compact_log(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Last whole line of each key in append-only JSON logs; cut lines go, and keys whose last value is blank.

    Of several files the one changed last wins, ties by name.
    """
    rows = last_wins(log_lines(located(spark.read.text(path)), key, value), key, value)
    return rows.where(F.trim(value) != "").select(key, value)
