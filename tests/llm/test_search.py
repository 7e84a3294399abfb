"""Importance resampling, ranked search and decontamination against brute force, in pieces and blocks."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameseek.llm import crc, decontaminate, resample, treaps
from frameseek.llm.terms import words

DOCS = "doc_id long, text string, n_words long, rank int, score string, items string, key string, term string, row long"
ITEMS = "item_id long, text string, doc_id string, n_words string"
#: As the contract writes words, on lower-cased text.
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(text):
    return PLAIN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def corpus(seed=5, n=120):
    """Ties, repeated rows, nulls, no words, long texts, words beyond ASCII, and copied passages."""
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "a1", "é", "日本", "x" * 40, "und", *[f"w{i}" for i in range(30)]]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", ", ", "-", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([25, 40, 12]))) for i in range(8)] + [(20, "W1 é w2"), (21, "und"), (22, None), (23, "... "), (3, text(15)), (None, text(11)), (30, "nowhere to be found")]
    rows = [(i, text(rng.choice([0, 1, 5, 19, 20, 60]))) for i in range(n)]
    for i, (_, t) in enumerate(items[:6]):
        cut = plain(t)[2:14]
        rows.append((n + i, text(9) + " ".join(cut).upper() + " " + text(5)))
    rows += [(500, None), (501, ""), (502, "!? \t"), (503, text(4000)), (None, text(30)), (None, text(30)), (7, rows[7][1]), (7, rows[9][1]), (504, rows[60][1]), (505, rows[60][1])]
    return rows, items


def frames(spark, rows, items):
    docs = spark.createDataFrame([(i, t, 1, 2, "s", "i", "k", "t", 3) for i, t in rows], DOCS).repartition(3)
    return docs, spark.createDataFrame([(i, t, "d", "n") for i, t in items], ITEMS)


def test_crc_combination_is_the_crc_of_the_whole():
    rng = random.Random(3)
    for n in (0, 1, 31, 32, 33, 127, 1000, 70_001):
        a, b = (bytes(rng.randrange(256) for _ in range(m)) for m in (rng.randrange(50), n))
        joined = crc.shift(np.array([zlib.crc32(a)], dtype=np.uint32), np.array([n]))[0] ^ zlib.crc32(b)
        assert joined == zlib.crc32(a + b)


@pytest.mark.parametrize("piece", [2_000_000, 150, 10])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_features_equal_spelled_out_ngrams(monkeypatch, piece, n):
    monkeypatch.setattr(resample, "PIECE", piece)
    texts = [None if t is None else t.encode() for _, t in corpus()[0]]
    got = [[] for _ in texts]
    for text, bucket in resample.features(texts, n, 10_000):
        for i, b in zip(text.tolist(), bucket.tolist()):
            got[i].append(b)
    for t, g in zip(texts, got):
        w = plain((t or b"").decode())
        want = [zlib.crc32(" ".join(w[j : j + k]).encode()) % 10_000 for k in range(1, n + 1) for j in range(len(w) - k + 1)]
        assert sorted(g) == sorted(want) and resample._words(len(want), n) == len(w)


def test_resampling_equals_brute_force(spark):
    rows, items = corpus()
    feats = lambda t: [zlib.crc32(g.encode()) % 10_000 for w in [plain(t)] for g in w + [" ".join(p) for p in zip(w, w[1:])]]
    corpus_n, target_n = (Counter(b for _, t in x for b in feats(t)) for x in (rows, items))
    s_all, t_all = sum(corpus_n.values()), sum(target_n.values())
    gain = lambda b: math.floor(1000 * math.log((target_n[b] + 1) * (s_all + 10_000) / ((corpus_n[b] + 1) * (t_all + 10_000))))
    want = []
    for i, t in rows:
        f = feats(t)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(plain(t))))
    able = sorted((r for r in want if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    draw = 25 * len(able) // 100
    got = resample.resample(*frames(spark, rows, items)).collect()
    assert sorted((repr((r.doc_id, r.n_features, r.weight, r.score, r.n_words)) for r in got)) == sorted(map(repr, want))
    drawn = sorted((r.rank, r.doc_id, r.score) for r in got if r["rank"] is not None)
    assert [(i, s) for _, i, s in drawn] == [(r[0], r[3]) for r in able[:draw]] and [r for r, _, _ in drawn] == list(range(1, draw + 1))


def test_resampling_empty_tables_and_one_hot_row(spark):
    docs, items = frames(spark, *corpus())
    assert resample.resample(docs.limit(0), items).count() == 0
    assert {r.weight for r in resample.resample(docs, items.limit(0)).where("n_features = 0").collect()} == {0}
    same = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b " * 20).alias("text"))
    ranks = [r["rank"] for r in resample.resample(same, items).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 101)) and ranks.count(None) == 300


def score_all(rows, items, k=20):
    docs = [(i, Counter(plain(t))) for i, t in rows if plain(t)]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(plain(t))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, n in terms.items() if c[t])
            if s > 0 and i is not None:
                found.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("shard,steps,block", [(8_000_000, 1 << 18, 50_000), (300, 8, 60), (1, 1, 10)])
def test_ranked_search_equals_scoring_everything(spark, monkeypatch, shard, steps, block):
    rows, items = corpus()
    docs, asked = frames(spark, rows, items)
    monkeypatch.setattr(treaps, "SHARD_BYTES", shard)
    monkeypatch.setattr(treaps, "STEPS", steps)
    index = treaps.build(docs)
    got = [tuple(r) for r in treaps.search(index, asked, block_terms=block).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, score_all(rows, items)))


def test_a_walk_skips_what_cannot_enter():
    rng = random.Random(2)
    ids, vocabulary, codes, lens = list(range(4000)), {}, [], []
    for _ in ids:
        text = [f"w{min(int(rng.paretovariate(0.6)), 3000)}" for _ in range(rng.randint(5, 200))]
        lens.append(len(text))
        codes += [vocabulary.setdefault(w.encode(), len(vocabulary)) for w in text]
    made = treaps._shard(ids, lens, codes, vocabulary)
    raw, counts = treaps._unpack(made[2])
    weights = {t: treaps.weight(len(ids), n) for t, n in zip(raw.split(b"\n"), np.frombuffer(counts, np.uint32).tolist())}
    forest = treaps.plant(dict(zip(("vocabulary", "docs", "postings"), made[2:])), weights, len(ids), sum(lens))
    nodes = np.arange(len(forest.doc))
    for child in (forest.left, forest.right):  # heaps by impact, search trees by document
        has = child != -1
        assert (forest.impact[nodes[has]] >= forest.impact[child[has]]).all() and (forest.term[nodes[has]] == forest.term[child[has]]).all()
        assert ((forest.doc[child[has]] < forest.doc[nodes[has]]) == (child is forest.left)).all()
    best = treaps.Best(1, 5)
    assert 0 < treaps.walk(forest, [{b"w7": 1, b"w40": 2, b"w1": 1}], best) < 1500 and len(best.query) == 5


def test_search_of_empty_tables(spark):
    docs, items = frames(spark, *corpus())
    assert treaps.rank(docs.limit(0), items).count() == 0 and treaps.rank(docs, items.limit(0)).count() == 0


def contaminate(rows, items, size=10):
    windows = {}
    for i, t in items:
        w = plain(t)
        m = min(size, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[j : j + m]), set()).add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w, hit, found = plain(t), set(), set()
        for m in {len(x) for x in windows}:
            for j in range(len(w) - m + 1):
                if got := windows.get(tuple(w[j : j + m])):
                    hit |= set(range(j, j + m))
                    found |= got
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block,stretch", [(100_000, 1000), (40, 1000), (15, 3)])
def test_decontamination_equals_brute_force(spark, monkeypatch, block, stretch):
    rows, items = corpus()
    monkeypatch.setattr(decontaminate, "STRETCH", stretch)
    docs, asked = frames(spark, rows, items)
    got = decontaminate.digest(decontaminate.find(docs, asked, block_words=block)).collect()
    want = contaminate(rows, items)
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want)) and sum(w[5] for w in want) >= 6


def test_wu_manber_finds_every_window_and_skips():
    rng = random.Random(4)
    for m in (1, 2, 3, 5, 10):
        for _ in range(50):
            text = [rng.choice([b"a", b"b", b"c"]) for _ in range(60)]
            item = [rng.choice([b"a", b"b", b"c"]) for _ in range(m + 3)]
            (table,) = decontaminate.tables([("i", b" ".join(item))], m)
            want = [j for j in range(len(text) - m + 1) if any(text[j : j + m] == item[k : k + m] for k in range(4))]
            assert [j for j, _ in table.search(text)] == want
    (table,) = decontaminate.tables([("i", b" ".join(b"p%d" % i for i in range(40)))], 10)

    class Seen(list):
        looked = 0

        def __getitem__(self, i):
            Seen.looked += isinstance(i, int)
            return super().__getitem__(i)

    assert not list(table.search(Seen([b"q"] * 9000))) and Seen.looked <= 2 * 9000 / 9 + 2


def test_decontamination_of_empty_tables(spark):
    docs, items = frames(spark, *corpus())
    assert decontaminate.find(docs.limit(0), items).count() == 0
    clean = decontaminate.digest(decontaminate.find(docs, items.limit(0)))
    assert clean.where("contaminated or n_items > 0").count() == 0 and clean.count() == docs.count()


def test_words_are_those_of_the_contract():
    rng = random.Random(6)
    for _ in range(300):
        t = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(0x80, 0x250), 0x3042, 0x1F600])) for _ in range(40))
        assert [w.decode() for w in words(t.encode())] == plain(t)
