"""Submission files: a rule check, an all-or-nothing sink, and a reader typed by file name.

An answer is (name, rank, video_id, frames, answer): ``name`` is the file's, its ending says what the
question is; ``frames`` has one frame, or one an event for a chain (trake); ``answer`` is a text for
qa and null otherwise. Files are CSV without header or BOM, CRLF line ends, quoted where needed.

The sink checks every file in the task that writes it. Files appear when all tasks are done and no
rule is broken; else the commit takes all back and says what is wrong.
"""

from __future__ import annotations

import csv
import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from frameseek.sources import storage

# The most rows of a file and characters of an answer, what files and videos are called, and a package's folder.
MOST_ROWS, MOST_CHARS = 100, 100
FILE_NAME, VIDEO_NAME = r"^query-.+-(kis|qa|trake)$", r"^[A-Za-z0-9_]+$"
FOLDER = "submission"

ROWS = "name string, rank int, video_id string, frames array<long>, answer string"


def kind(name: Column) -> Column:
    """kis, qa or trake, '' for a name that is no question's."""
    return F.regexp_extract(name, FILE_NAME, 1)


def violations(rows: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """(name, rank, rule): every rule that rows break, rank null for one of a whole file; ``events``: name, events asked.

    name: the ending is unknown, and no other rule is tried. rows: over 100. kind: an answer or chain where none
    belongs, or none where one does. suffix, video: a video with .mp4, or other odd characters. frame: null or
    below 0. blank, long: an answer without text, or over 100 characters. events: not as many as asked. order: frames that
    fall. twice: equal to a row before. lengths: chains of several lengths.
    """
    named = rows.withColumn("kind", kind(F.col("name")))
    unknown = named.where("kind = ''").select("name").distinct().select("name", F.lit(None).cast("int").alias("rank"), F.lit("name").alias("rule"))
    r = named.where("kind <> ''").withColumn("n", F.coalesce(F.size("frames"), F.lit(0)))
    if events is not None:
        r = r.join(events.select("name", F.col("events").alias("asked")), "name", "left")
    else:
        r = r.withColumn("asked", F.lit(None).cast("int"))
    chain = F.col("kind") == "trake"
    fits = F.when(chain, (F.col("n") > 0) & F.col("answer").isNull()).when(F.col("kind") == "qa", (F.col("n") == 1) & F.col("answer").isNotNull()).otherwise((F.col("n") == 1) & F.col("answer").isNull())
    video = F.coalesce("video_id", F.lit(""))
    rising = F.forall(F.zip_with("frames", F.slice("frames", F.lit(2), F.greatest(F.col("n") - 1, F.lit(0))), lambda a, b: b.isNull() | a.isNull() | (a <= b)), lambda x: x)
    blank = F.trim(F.regexp_replace("answer", r"\s", " ")) == ""
    rules = {
        "kind": ~fits,
        "suffix": fits & F.lower(video).endswith(".mp4"),
        "video": fits & ~F.lower(video).endswith(".mp4") & ~video.rlike(VIDEO_NAME),
        "frame": fits & F.exists("frames", lambda f: f.isNull() | (f < 0)),
        "blank": fits & (F.col("kind") == "qa") & blank,
        "long": fits & (F.col("kind") == "qa") & ~blank & (F.length("answer") > MOST_CHARS),
        "events": fits & chain & F.col("asked").isNotNull() & (F.col("asked") != F.col("n")),
        "order": fits & chain & ~rising,
    }
    single = r.select("name", "rank", F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())).alias("rule"))
    # One row a file, and one a different row.
    files = r.groupBy("name").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.when(chain & fits, F.col("n"))).alias("lengths"))
    whole = files.select("name", F.lit(None).cast("int").alias("rank"), F.explode(F.filter(F.array(F.when(F.col("rows") > MOST_ROWS, "rows"), F.when(F.col("lengths") > 1, "lengths")), lambda x: x.isNotNull())).alias("rule"))
    same = r.groupBy("name", "video_id", "frames", "answer").agg(F.count(F.lit(1)).alias("c"), F.max("rank").alias("rank")).where("c > 1")
    return unknown.union(single).union(whole).union(same.select("name", "rank", F.lit("twice").alias("rule")))


def problems(name: str, rows: list[dict], events: int | None = None) -> list[tuple[int | None, str]]:
    """``violations`` of one file, of at most some hundred rows, where it is written or read back."""
    found, match = [], re.match(FILE_NAME, name)
    if not match:
        return [(None, "name")]
    if len(rows) > MOST_ROWS:
        found.append((None, "rows"))
    seen, lengths, what = {}, set(), match.group(1)
    for r in rows:
        frames, answer, video, rank = r["frames"] or [], r["answer"], r["video_id"] or "", r["rank"]
        if not (len(frames) > 0 and answer is None if what == "trake" else len(frames) == 1 and (answer is None) == (what == "kis")):
            found.append((rank, "kind"))
        else:
            found += [(rank, "suffix")] * video.lower().endswith(".mp4") or [(rank, "video")] * (not re.match(VIDEO_NAME, video))
            found += [(rank, "frame")] * any(f is None or f < 0 for f in frames)
            if what == "qa":
                found += [(rank, "blank")] * (not answer.strip()) or [(rank, "long")] * (len(answer) > MOST_CHARS)
            if what == "trake":
                lengths.add(len(frames))
                found += [(rank, "events")] * (events is not None and len(frames) != events)
                found += [(rank, "order")] * any(a > b for a, b in zip(frames, frames[1:]) if a is not None and b is not None)
        key = video, tuple(frames), answer
        seen[key] = [*seen.get(key, ()), rank]
    found += [(None, "lengths")] * (len(lengths) > 1)
    return found + [(max((x for x in ranks if x is not None), default=None), "twice") for ranks in seen.values() if len(ranks) > 1]


def to_csv(rows: list[dict]) -> bytes:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\r\n", quoting=csv.QUOTE_MINIMAL)
    for r in rows:
        writer.writerow([r["video_id"], *r["frames"], *([] if r["answer"] is None else [r["answer"]])])
    return out.getvalue().encode()


def from_csv(name: str, data: bytes) -> list[dict]:
    """Rows of a file, typed by its name; a BOM, an unknown ending or a frame that is no number is an error."""
    match = re.match(FILE_NAME, name)
    if not match:
        raise ValueError(f"{name}: the name says no kind of question")
    if data.startswith(b"\xef\xbb\xbf"):
        raise ValueError(f"{name}: the file begins with a byte order mark")
    rows = [r for r in csv.reader(io.StringIO(data.decode(), newline="")) if r]
    last = {"kis": lambda r: 2, "qa": lambda r: 2, "trake": len}[match.group(1)]
    return [{"name": name, "rank": i, "video_id": r[0], "frames": [int(x) for x in r[1 : last(r)]], "answer": (r[2] if len(r) > 2 else "") if match.group(1) == "qa" else None} for i, r in enumerate(rows, 1)]


# --- The sink ---


@dataclass
class Files(WriterCommitMessage):
    """What a task has written, under the name it will have, and what is wrong."""

    written: dict[str, str] = field(default_factory=dict)
    wrong: list[tuple[str, int | None, str]] = field(default_factory=list)


class Sink(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        # Made once, in the driver, and the same in every task.
        self.path, self.job = options["path"], f"_{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Files:
        system, path = storage.at(self.path)
        files: dict[str, list[dict]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                held = files.setdefault(r["name"] or "", [])
                if len(held) <= 10 * MOST_ROWS:  # more of a file that is wrong anyway need not be held
                    held.append(r)
        out = Files()
        for name, rows in sorted(files.items()):
            rows.sort(key=lambda r: (r["rank"] is None, r["rank"]))
            out.wrong += [(name, *p) for p in problems(name, rows, rows[0]["events"])]
            if not out.wrong:
                hidden = f"{path}/{self.job}/{uuid.uuid4().hex}"
                system.create_dir(f"{path}/{self.job}", recursive=True)
                with system.open_output_stream(hidden) as f:
                    f.write(to_csv(rows))
                out.written[hidden] = f"{path}/{name}.csv"
        return out

    def commit(self, messages: list[Files | None]) -> None:
        system, _ = storage.at(self.path)
        wrong = [w for m in messages if m for w in m.wrong]
        files = {hidden: final for m in messages if m for hidden, final in m.written.items()}
        if wrong or len(files) != len(set(files.values())):
            storage.remove(f"{self.path}/{self.job}")
            raise ValueError(f"nothing written: {wrong[:20] or 'the rows of a file are in several tasks'}")
        storage.settle(system, files)
        storage.remove(f"{self.path}/{self.job}")

    def abort(self, messages: list[Files | None]) -> None:
        storage.remove(f"{self.path}/{self.job}")


class Submission(DataSource):
    @classmethod
    def name(cls) -> str:
        return "submission"

    def schema(self) -> str:
        return f"{ROWS}, events int"

    def writer(self, schema, overwrite: bool) -> Sink:
        return Sink(self.options)


def write(rows: DataFrame, folder: str, events: DataFrame | None = None) -> None:
    """One file a name, all or none; ``events`` (name, events) says how long chains are to be."""
    rows.sparkSession.dataSource.register(Submission)
    asked = rows.join(events.select("name", F.col("events").cast("int").alias("events")), "name", "left") if events is not None else rows.withColumn("events", F.lit(None).cast("int"))
    chosen = asked.select("name", F.col("rank").cast("int").alias("rank"), F.col("video_id").cast("string").alias("video_id"), F.col("frames").cast("array<bigint>").alias("frames"), "answer", "events")
    # A file has 100 rows at most, or is wrong: its rows are one task's work.
    chosen.repartition("name").write.format("submission").mode("append").option("path", folder).save()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all files of a folder as they were written, typed by file name; a BOM or an odd name is an error."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("name", pa.string()), ("rank", pa.int32()), ("video_id", pa.string()), ("frames", pa.list_(pa.int64())), ("answer", pa.string())])
        for batch in batches:
            rows = [r for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in from_csv(path.rpartition("/")[2].removesuffix(".csv"), data)]
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path", "content")
    return files.mapInArrow(task, ROWS)


# --- Packages ---


def pack(folder: str, to: str) -> None:
    """The files of a written folder as a ZIP, inside the folder that a package must have."""
    system, path = storage.at(folder)
    names = storage.files(folder, "*.csv")
    if not names:
        raise ValueError(f"{folder} has no files")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in names:
            with system.open_input_stream(name) as f:
                z.writestr(f"{FOLDER}/{name.rpartition('/')[2]}", f.read())
    target, at = storage.at(to)
    with target.open_output_stream(at) as f:
        f.write(out.getvalue())


def package_problems(name: str, data: bytes) -> list[tuple[str, str]]:
    """(file, code) of what is wrong with a package: zip, empty, outside, csv, deep, unreadable, space, and ``problems`` of its files."""
    if not name.lower().endswith(".zip"):
        return [(name, "zip")]
    found = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [i.filename for i in z.infolist() if not i.is_dir()]
        if not names:
            return [(name, "empty")]
        found += [(n, "outside") for n in names if not n.startswith(f"{FOLDER}/")]
        found += [(n, "csv") for n in names if not n.lower().endswith(".csv")]
        found += [(n, "deep") for n in names if n.count("/") > 1]
        for n in sorted(n for n in names if n.lower().endswith(".csv")):
            body = z.read(n)
            base = n.rpartition("/")[2][: -len(".csv")]
            try:
                rows = from_csv(base, body)
            except ValueError:
                found.append((n, "unreadable"))
                continue
            found += [(n, rule) for _, rule in problems(base, rows)] or [(n, "empty")] * (not rows)
            if any(cell != cell.strip() for row in csv.reader(io.StringIO(body.decode(), newline="")) for cell in row):
                found.append((n, "space"))
    return found


def check_packages(spark: SparkSession, path: str) -> DataFrame:
    """(package, file, code) for all packages of a folder, each checked in one task; a sound one has no row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p.rpartition("/")[2], *x) for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in package_problems(p.rpartition("/")[2], data)]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["package", "file", "code"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(task, "package string, file string, code string")
