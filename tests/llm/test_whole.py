"""The training-data operators over all of a text and its contexts."""

import random
import time

import numpy as np

from frameseek.llm import fingerprints, pii
from frameseek.llm.common import Scratch


def test_likeness_of_short_texts_is_their_shingles():
    rng = random.Random(8)
    for _ in range(200):
        a = [f"w{rng.randrange(1000)}" for _ in range(rng.randint(8, 40))]
        b = a[: len(a) - len(a) // 4] + [f"v{i}" for i in range(len(a) // 4)]
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        near, inside = fingerprints.compare(fingerprints.sketch(" ".join(a)), fingerprints.sketch(" ".join(b)))
        assert abs(near - len(x & y) / len(x | y)) < 1e-12 and abs(inside - len(x & y) / len(x)) < 1e-12


def test_pii_one_cue_word_or_a_gap_is_a_pattern(spark):
    words = [f"w{'abcdefghijklmnopqrstuvwxyz'[i // 26]}{'abcdefghijklmnopqrstuvwxyz'[i % 26]}" for i in range(200)]
    rows = [(i, f"{words[i]} phone +49 30 1234{i:04d} {words[i + 60]}") for i in range(40)]
    rows += [(100 + i, f"reach {words[i]} mail{i}@example.com {words[i + 60]}") for i in range(40)]
    # Other neighbours than any seed's; the last has no cue.
    rows += [(300, "qqq phone 0301234 rrr"), (301, "reach qqq me@localhost rrr"), (302, "sss number 20240101 ttt")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[300].spans == "phone:10:17" and got[301].spans == "email:10:22"
    assert got[302].n_added == 0 and sum(r.n_added for r in got.values()) == 2


def test_merged_sketches_are_the_sketch_of_all_shingles():
    rng = random.Random(9)
    for bits in (0, 1, 3, 6):
        for _ in range(300):
            a, b = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([0, 2, 6, 40]))) for _ in range(2))
            hashes = [fingerprints.shingle_hashes(fingerprints.word_hashes(t.encode())) for t in (a, b)]
            both = fingerprints._kept(np.unique(np.concatenate(hashes) >> np.uint64(16)), bits)
            assert (fingerprints.merge(fingerprints.sketch(a, bits=bits), fingerprints.sketch(b, bits=bits), bits) == both).all()


def test_pii_long_runs_are_linear():
    began = time.time()
    assert pii.base_spans("1.1.1." + "0" * 5000) == [(0, 5006, 1)]
    for text in ("x" * 1_000_000 + "1234", "1" * 1_000_000, "+" * 1_000_000 + "1", "@" * 1_000_000, "a@" * 300_000, "1." * 300_000, "+1 " * 300_000, "1 " * 300_000):
        pii.candidates(text, pii.base_spans(text))
    assert time.time() - began < 60


def test_scratch_leaves_nothing_in_the_catalogue(spark):
    before, scratch = {t.name for t in spark.catalog.listTables()}, Scratch(spark, "t")
    made = scratch.save_bucketed(spark.range(20).withColumnRenamed("id", "k"), "x", "k", 4)
    assert made.count() == 20 and len({t.name for t in spark.catalog.listTables()} - before) == 1
    scratch.drop("x")
    assert {t.name for t in spark.catalog.listTables()} == before


def test_pii_forms_are_told_apart():
    assert pii.instance("10.1.23.4") != pii.instance("101234") and pii.instance("+1 (555) 123") == pii.instance("+1-555-123")
    text = "call +1 (826) 555-4081 190.137.223.20 or 300.1.1.1 now"
    assert pii.base_spans(text) == [(23, 37, 1)]  # the phone's run has too many digits and goes; each kind is matched for itself
    found = [text[c["start"] : c["end"]] for c in pii.candidates(text, [])]
    # Whole forms, and tokens of them that look like identifiers by themselves.
    assert [x for x in found if x != "555-4081"] == ["+1 (826) 555-4081", "190.137.223.20"]


def test_pii_bootstrap_equals_brute_force(spark):
    rng = random.Random(11)
    rows = [([f"p{rng.randrange(12)}" for _ in range(rng.randint(1, 3))], f"i{i}", rng.choice([-1, -1, 0, 1]) if i % 7 else 0) for i in range(80) for _ in range(rng.randint(1, 2))]
    kind: dict = {}
    for _, i, k in rows:
        kind[i] = max(k, kind.get(i, -1))
    edges = {(p, i) for ps, i, _ in rows for p in ps}
    seeds = {i: (k, 1.0) for i, k in kind.items() if k >= 0}
    known = dict(seeds)
    for _ in range(3):
        worth: dict = {}
        for p in {p for p, _ in edges}:
            mine = {i for q, i in edges if q == p}
            for k in (0, 1):
                trusted = [known[i][1] for i in mine if i in known and known[i][0] == k]
                if len(trusted) >= 3 and sum(trusted) / len(mine) >= 0.3:
                    worth[p, k] = sum(trusted) / len(mine)
        found = {}
        for i in {i for i, k in kind.items() if k < 0}:
            scores = []
            for k in (0, 1):
                votes = [min(worth[p, k], 0.95) for p, j in edges if j == i and (p, k) in worth]
                if votes:
                    scores.append((1 - np.prod([1 - v for v in votes]), k))
            if scores and max(scores)[0] >= 0.5:
                found[i] = (max(scores)[1], max(scores)[0])
        known = seeds | found
    assert len(known) > len(seeds)
    table = spark.createDataFrame(rows, "patterns array<string>, inst string, kind int")
    got = {r.inst: (r.kind, r.confidence) for r in pii.bootstrap(table, Scratch(spark, "t"), trust=0.3, accept=0.5).collect()}
    assert got.keys() == known.keys() and all(got[i][0] == k and abs(got[i][1] - c) < 1e-9 for i, (k, c) in known.items())


def test_pii_finds_what_runs_together_hid(spark):
    rows = [(i, f"w{i} +1 ({200 + i}) 555-{1000 + i} x{i}") for i in range(30)] + [(50, "qq +1 (826) 555-4081 190.137.223.20 zz")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50].n_phone == 0 and got[50].n_ip == 1 and got[50].spans == "phone:3:20,ip:21:35" and got[50].n_added == 1
