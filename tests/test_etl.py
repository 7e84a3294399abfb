"""The master build and its outputs, and sources and sinks that go through files."""

import io
import json
import os
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameseek.operators import master, numbering
from frameseek.sources import files, matrices, submission
from frameseek.streaming import logs

# --- numbering ---


def test_numbers_run_through_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(30), i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, k int, i int").repartition(5)
    got = numbering.placed(df, "g", [F.asc("k"), F.asc("i")]).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1], r[2]))
    places, seen = {}, {}
    for n, (g, _, i) in enumerate(order):
        seen[g] = seen.get(g, 0) + 1
        places[i] = (n, seen[g])
    assert {r.i: (r.row_id, r.n) for r in got} == places
    assert numbering.numbered(df.limit(0), [F.asc("k")]).count() == 0


# --- master build ---

FULL = list(master.NEEDED)


def assets(spark):
    """A sound video and one for each code."""
    shape = {"ok": 3, "columns": 2, "images": 2, "vectors": 2, "width": 1, "no_vectors": 1, "no_meta": 1}
    frames = [(v, n, float(n), 25.0, n * 25) for v, c in shape.items() for n in range(c, 0, -1)] + [(None, 1, 1.0, 25.0, 25)]
    images = [(v, f"{n:03d}.{'JPG' if n == 1 else 'jpg'}", f"/k/{v}/{n}") for v, c in shape.items() for n in range(1, c + 1) if v != "images" or n == 1]
    images += [("ok", "notes.txt", "/k/ok/notes"), ("no_file", "001.jpg", "/k")]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "videos": make([(v, f"/v/{v}.mp4") for v in [*shape, "no_file"]] + [(None, "x")], "video_id string, video_path string"),
        "frames": make(frames, "video_id string, n long, pts_time double, fps double, frame_idx long"),
        "headers": make([(v, FULL[1:] if v == "columns" else [*FULL, "more"]) for v in shape], "video_id string, columns array<string>"),
        "images": make(images, "video_id string, name string, path string"),
        "vectors": make([(v, c + (v == "vectors"), 64 if v == "width" else 512) for v, c in shape.items() if v != "no_vectors"], "video_id string, rows long, width int"),
        "meta": make([(v, f"title {v}", None, ["a", "b"], 9, None) for v in shape if v != "no_meta"], "video_id string, title string, description string, keywords array<string>, length long, publish_date string"),
        "objects": make([("ok", "001", "/o/1"), ("ok", "3", "/o/no"), ("images", "001", "/o/i1"), ("images", "002", "/o/i2"), ("columns", "001", "/o")], "video_id string, stem string, path string"),
    }


def test_every_code_and_the_joined_master(spark):
    rows, problems, seen = master.build(**assets(spark))
    got = [(r.video_id, r.code, r.detail) for r in problems.collect()]
    assert sorted(got) == sorted([
        ("no_file", "thieu_csv", ""), ("columns", "csv_thieu_cot", "pts_time, fps, frame_idx"), ("images", "lech_so_keyframe", "csv=2 anh=1"),
        ("vectors", "lech_so_vector", "csv=2 npy=3"), ("width", "sai_chieu_vector", "(1, 64)"), ("no_vectors", "thieu_npy", ""), ("no_meta", "thieu_metadata", ""),
    ]) and {c for _, c, _ in got} == set(master.CODES)
    made = sorted(rows.collect(), key=lambda r: r.row_id)
    # By video, then n; images in the order of their names, an object by the image's name or, without one, by n.
    assert [(r.row_id, r.video_id, r.kf_n, r.kf_name, r.obj_path) for r in made] == [
        (0, "images", 1, "001.JPG", "/o/i1"), (1, "images", 2, None, "/o/i2"), (2, "no_meta", 1, "001.JPG", None), (3, "no_vectors", 1, "001.JPG", None),
        (4, "ok", 1, "001.JPG", "/o/1"), (5, "ok", 2, "002.jpg", None), (6, "ok", 3, "003.jpg", None), (7, "vectors", 1, "001.JPG", None), (8, "vectors", 2, "002.jpg", None), (9, "width", 1, "001.JPG", None)]
    assert {r.video_id for r in made if r.has_clip} == {"ok", "images", "no_meta"}
    assert made[4].title == "title ok" and made[4].keywords == "a b" and made[4].publish_date == "" and made[4].video_path == "/v/ok.mp4" and made[2].title == ""
    assert {k: seen.get[k] for k in ("rows", "with_image", "with_objects", "with_vector")} == {"rows": 10, "with_image": 9, "with_objects": 3, "with_vector": 6}


def test_paths_of_today_and_counters(spark):
    rows = [(1, "v", None, None, "/old/v"), (2, "v", "x.jpg", "/old/2", "/old/v"), (3, "v", None, "/old/3", "/old/v"), (4, "w", "y.jpg", "/gone", "/gone/w"), (1234, "w", None, "/new/1234", None), (5, None, None, None, None)]
    m = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "kf_n int, video_id string, kf_name string, kf_path string, video_path string, row_id int")
    images = spark.createDataFrame([("v", "001.jpg", "/new/1"), ("w", "1234.jpg", "/new/1234"), ("w", "001.jpg", "/new/w1")], "video_id string, name string, path string")
    videos = spark.createDataFrame([("u", "/new/u")], "video_id string, path string")
    there = spark.createDataFrame([("/old/2",), ("/old/3",), ("/old/v",), ("/old/2",), (None,)], "path string")
    out, seen = master.patched(m, images, videos, there)
    got = {r.row_id: (r.kf_name, r.kf_path, r.video_path) for r in out.collect()}
    assert got == {0: ("001.jpg", "/new/1", "/old/v"), 1: ("x.jpg", "/old/2", "/old/v"), 2: ("003.jpg", "/old/3", "/old/v"), 3: (None, None, None), 4: ("1234.jpg", "/new/1234", None), 5: (None, None, None)}
    assert out.columns == m.columns and [seen.get[f"{k}_{s}"] for k in ("image", "video") for s in ("new", "kept", "none")] == [1, 3, 2, 0, 3, 3]


# --- matrices ---


def rows_of(df):
    return {(os.path.basename(r.file), r.pos): r.v for r in df.collect()}


def test_matrices_are_read_by_ranges(spark, tmp_path):
    whole = np.arange(600, dtype=np.float16).reshape(100, 6)
    np.save(tmp_path / "a.npy", whole)
    np.save(tmp_path / "b.npy", np.asfortranarray(whole[:7].astype(np.float32)))
    np.save(tmp_path / "_hidden.npy", whole)
    (tmp_path / "sub").mkdir()
    np.save(tmp_path / "sub" / "c.npy", np.zeros((0, 6), dtype=np.float32))
    df = matrices.read(spark, f"file://{tmp_path}", range_bytes=12 * 9)
    assert df.rdd.getNumPartitions() >= 12 and dict(df.dtypes)["v"] == "array<float>"
    got = rows_of(df)
    assert len(got) == 107 and all(got["a.npy", i] == whole[i].tolist() for i in range(100)) and all(got["b.npy", i] == whole[i].tolist() for i in range(7))


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_members_of_archives(spark, tmp_path, save):
    vec = np.random.default_rng(0).random((50, 4)).astype(np.float32)
    save(tmp_path / "q.npz", vec=vec, row_id=np.arange(50) * 3, said=np.array([f"câu {i}" for i in range(50)]), note=np.array([0.5, 1.5]))
    of = lambda m: matrices.read(spark, f"file://{tmp_path}", m, 160)
    assert of("vec").rdd.getNumPartitions() == (5 if save is np.savez else 1)
    assert [v for _, v in sorted(rows_of(of("vec")).items())] == vec.tolist()
    assert rows_of(of("row_id"))["q.npz", 7] == 21 and dict(of("row_id").dtypes)["v"] == "bigint"
    assert rows_of(of("said"))["q.npz", 49] == "câu 49" and rows_of(of("note"))["q.npz", 1] == 1.5


def test_written_matrices_come_back_or_none(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(40)], "row_id int, v array<double>").repartition(3)
    matrices.write(df, f"file://{tmp_path}/out", rows=5)
    ids, vec = (rows_of(matrices.read(spark, f"file://{tmp_path}/out", m)) for m in ("row_id", "vec"))
    assert {i: vec[k] for k, i in ids.items()} == {i: [float(i), 0.5] for i in range(40)} and len({f for f, _ in ids}) >= 8
    bad = df.union(spark.createDataFrame([(99, [1.0])], "row_id int, v array<double>")).coalesce(1)
    with pytest.raises(Exception, match="one length"):
        matrices.write(bad, f"file://{tmp_path}/bad", rows=7)
    assert not [f for _, _, some in os.walk(tmp_path / "bad") for f in some]


# --- submissions ---

KIS, QA, CHAIN = "query-p1-1-kis", "query-2-qa", "query-p1-3-trake"
SOUND = [(KIS, 1, "L01_V001", [5], None), (KIS, 2, "L01_V001", [6], None), (QA, 1, "L01_V001", [5], 'say "x", y\nz'), (QA, 2, "L01_V001", [5], " kept "), (CHAIN, 1, "L02_V1", [1, 1, 3], None), (CHAIN, 2, "L02_V1", [0, 2, 3], None)]
BROKEN = {
    "name": [("query-1-vqa", 1, "V", [1], None)],
    "rows": [(KIS, i, "V", [i + 10], None) for i in range(3, 102)],
    "kind": [(KIS, 3, "V", [1], "an answer")],
    "suffix": [(KIS, 3, "V.mp4", [1], None)],
    "video": [(KIS, 3, "L01 V1", [1], None)],
    "frame": [(KIS, 3, "V", [-1], None)],
    "blank": [(QA, 3, "V", [1], " \t ")],
    "long": [(QA, 3, "V", [1], "x" * 101)],
    "events": [("query-9-trake", 1, "V", [1, 2], None)],
    "order": [(CHAIN, 3, "V", [1, 3, 2], None)],
    "lengths": [("query-8-trake", 1, "V", [1, 2], None), ("query-8-trake", 2, "V", [1, 2, 3], None)],
    "twice": [(QA, 3, "L01_V001", [5], " kept ")],
}


def answers(spark, rows):
    return spark.createDataFrame(rows, submission.ROWS)


def test_sound_answers_come_back_as_they_are(spark, tmp_path):
    place = f"file://{tmp_path}/out"
    submission.write(answers(spark, SOUND).repartition(3), place, spark.createDataFrame([(CHAIN, 3)], "name string, events int"))
    assert sorted(os.listdir(tmp_path / "out")) == [f"{n}.csv" for n in sorted({KIS, QA, CHAIN})]
    assert (tmp_path / "out" / f"{QA}.csv").read_bytes() == b'L01_V001,5,"say ""x"", y\nz"\r\nL01_V001,5, kept \r\n'
    assert sorted(map(tuple, submission.read(spark, place).collect())) == sorted(SOUND)
    assert submission.violations(answers(spark, SOUND)).count() == 0


@pytest.mark.parametrize("rule", BROKEN)
def test_a_broken_rule_leaves_no_file(spark, tmp_path, rule):
    rows, events = answers(spark, SOUND + BROKEN[rule]), spark.createDataFrame([(CHAIN, 3), ("query-9-trake", 3)], "name string, events int")
    assert {r.rule for r in submission.violations(rows, events).collect()} == {rule}
    with pytest.raises(Exception, match=f"'{rule}'"):
        submission.write(rows, f"file://{tmp_path}/out", events)
    assert not os.path.exists(tmp_path / "out") or not os.listdir(tmp_path / "out")


def test_files_with_a_mark_or_an_odd_name_are_errors(spark, tmp_path):
    for name, data in ((KIS, b"\xef\xbb\xbfV,1\r\n"), ("odd", b"V,1\r\n"), (KIS, b"V,one\r\n")):
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / f"{name}.csv").write_bytes(data)
        with pytest.raises(Exception):
            submission.read(spark, f"file://{tmp_path}/{name}").collect()


def test_packages(spark, tmp_path):
    place = f"file://{tmp_path}/out"
    submission.write(answers(spark, [r for r in SOUND if r[4] != " kept "]), place)
    (tmp_path / "zips").mkdir()
    submission.pack(place, f"file://{tmp_path}/zips/good.zip")

    def odd(name, *entries):
        with zipfile.ZipFile(tmp_path / "zips" / name, "w") as z:
            for path, data in entries:
                z.writestr(path, data)

    fine = f"{submission.FOLDER}/{KIS}.csv"
    odd("none.zip")
    odd("flat.zip", (f"{KIS}.csv", b"V,1\r\n"))
    odd("deep.zip", (f"{submission.FOLDER}/x/{KIS}.csv", b"V,1\r\n"))
    odd("more.zip", (fine, b"V,1\r\n"), (f"{submission.FOLDER}/notes.txt", b"x"))
    odd("mark.zip", (fine, b"\xef\xbb\xbfV,1\r\n"))
    odd("space.zip", (f"{submission.FOLDER}/{QA}.csv", b'V,1, "5"\r\n'))
    odd("twice.zip", (fine, b"V,1\r\nV,1\r\n"))
    (tmp_path / "zips" / "pack.rar").write_bytes(b"x")
    got = {(r.package, r.code) for r in submission.check_packages(spark, f"file://{tmp_path}/zips").collect()}
    assert got == {("none.zip", "empty"), ("flat.zip", "outside"), ("deep.zip", "deep"), ("more.zip", "csv"), ("mark.zip", "unreadable"), ("space.zip", "space"), ("twice.zip", "twice"), ("pack.rar", "zip")}


# --- logs ---


def test_a_stopped_log_stream_goes_on_to_the_batch_result(spark, tmp_path):
    rng = random.Random(4)
    line = lambda k, v: json.dumps({"row_id": k, "caption": v})
    (tmp_path / "in").mkdir()

    def log(n):
        text = "\n".join([line(rng.randrange(12), rng.choice([f"v{n}-{i}", f"v{n}-{i}", " ", None])) for i in range(30)] + ['{"row_id": 3, "capt', '{"caption": "no key"}', "", '{"row_id": "x", "caption": "bad key"}'])
        (tmp_path / "in" / f"{rng.randrange(1000)}-{n}.jsonl").write_text(text)
        os.utime(tmp_path / "in" / next(f for f in os.listdir(tmp_path / "in") if f.endswith(f"-{n}.jsonl")), (1_700_000_000 + n,) * 2)

    places = [f"file://{tmp_path}/{x}" for x in ("in", "out", "cp")]
    follow = lambda: logs.follow(spark, *places, "row_id", "caption", 1)
    now = lambda where: {r.row_id: r.caption for r in logs.current(spark, where, "row_id", "caption").collect()}
    batch = lambda: {r.row_id: r.caption for r in files.compact_log(spark, places[0], "row_id", "caption").collect()}
    for n in range(4):
        log(n)
    follow().awaitTermination()
    assert now(places[1]) == batch() and len(os.listdir(tmp_path / "out")) >= 4

    # A stop after a batch was written and before its end was noted: that batch comes again.
    for n in range(4, 7):
        log(n)
    failing, write = [], files.last_wins

    def stopped(*a):
        failing.append(1)
        if len(failing) == 2:
            raise RuntimeError("stopped")
        return write(*a)

    files.last_wins = stopped
    try:
        with pytest.raises(Exception):
            follow().awaitTermination()
    finally:
        files.last_wins = write
    commits = tmp_path / "cp" / "commits"
    os.remove(commits / str(max(int(f) for f in os.listdir(commits) if f.isdigit())))
    for f in os.listdir(commits):
        if f.startswith("."):
            os.remove(commits / f)
    follow().awaitTermination()
    assert now(places[1]) == batch()
    logs.fold(spark, places[1], f"file://{tmp_path}/folded", "row_id", "caption")
    assert now(f"file://{tmp_path}/folded") == batch()


# --- small files ---


def test_small_files_all_or_none(spark, tmp_path):
    from frameseek.sources import blobs

    make = lambda rows: spark.createDataFrame(rows, "path string, content string").repartition(3)
    blobs.write(make([("a/b/x.txt", "é"), ("a/y", None), ("z.csv", "1,2")]), f"file://{tmp_path}/out")
    seen = {os.path.relpath(os.path.join(d, f), tmp_path / "out"): open(os.path.join(d, f), encoding="utf-8").read() for d, _, some in os.walk(tmp_path / "out") for f in some}
    assert seen == {"a/b/x.txt": "é", "a/y": "", "z.csv": "1,2"}
    for bad in ([("a", "1"), ("a", "2")], [("ok", "1"), ("../up", "2")], [("ok", "1"), (None, "2")], [("ok", "1"), ("_x", "2")]):
        with pytest.raises(Exception):
            blobs.write(make(bad), f"file://{tmp_path}/bad")
        # A task that was still at work may leave something in the job's own folder, which nothing lists.
        assert [f for f in os.listdir(tmp_path / "bad") if f[0] != "_"] == [] if os.path.exists(tmp_path / "bad") else True


def test_detections_stop_at_the_first_low_score(spark, tmp_path):
    rows = {
        "a": {"detection_scores": [0.9, 0.3, 0.8], "detection_class_entities": ["Car", "Bus", "Man"], "detection_boxes": [[0, 0, 1, 1]] * 3},
        "b": {"detection_scores": [0.9, 0.5], "detection_class_entities": ["Car"]},
        "c": {"detection_class_entities": ["Car"]},
        "d": {"detection_scores": [0.1]},
        "e": {"detection_scores": [0.7, None, 0.6]},
    }
    (tmp_path / "v").mkdir()
    for name, r in rows.items():
        (tmp_path / "v" / f"{name}.json").write_text(json.dumps(r))
    (tmp_path / "v" / "cut.json").write_text('{"detection_scores": [0.9')
    (tmp_path / "v" / "empty.json").write_text("")
    got = sorted((os.path.basename(r.path)[0], r.pos, r.label, r.score, r.box) for r in files.detections(spark, f"file://{tmp_path}", 0.5).collect())
    assert got == [("a", 0, "Car", 0.9, [0.0, 0.0, 1.0, 1.0]), ("b", 0, "Car", 0.9, None), ("b", 1, None, 0.5, None), ("e", 0, None, 0.7, None)]


def test_coverage_counts_assets_by_group(spark, tmp_path):
    for path in ("v/L01_V001.mp4", "c/L01_V001.csv", "c/L01_V002.CSV", "k/L02_V0001/001.jpg", "k/L02_V0001/002.jpg", "n/notes.txt", "c/other.csv"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    found = files.discover(spark, f"file://{tmp_path}")
    assert sorted(tuple(r) for r in files.coverage(found).select("grp", "videos", "csv", "video", "keyframe_dir").collect()) == [("L01", 2, 2, 1, 0), ("L02", 1, 0, 0, 1)]
