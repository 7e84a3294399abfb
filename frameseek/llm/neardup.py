"""Near-duplicate classes by order MinHash, verified by banded alignment.

A text's k-mers are its 5-word shingles labelled with their occurrence number. For each
hash function the two k-mers with the least hashes are kept in the order of the text
(order MinHash: swapping passages changes it), and two functions make one of BANDS
signatures. Texts that share a signature are candidates. A candidate pair is linked if
its banded alignment over words leaves a similarity 1 - distance / longer length of at
least 0.8. Classes are the connected components of the links; a class is named by its
least document id.

How groups stay bounded. Equal texts are one node. In a bucket of equal signatures
each text is compared with the least one only, so a bucket gives one pair a member.
A bucket that falls into more than one component after that goes to the exact rest:
its members are joined on their rarest words. Similar texts share at least 80 % of
their words, so with any common order of words they share one among the first 20 %
and one of each; the order used puts corpus-rare words first, so what a crowd of
texts shares comes last and is not a key. A pair is needed once, at the first word in
that order that both have: a later word does not pair two texts if its rank leaves too
few words to share, or if they share one of the EARLIER words before it. No bucket,
partner or candidate is capped.

Defined results: a text that is null or has no word is a class of its own. A null id
gets a null class and takes no part. Rows that repeat an id and text share the class;
texts that share an id are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameseek.llm.common import Scratch, parts_for, prepare, shielded, total_chars
from frameseek.llm.components import connected_components
from frameseek.llm.hashing import mix, shingle_hashes, word_hashes

SIMILARITY = 0.8
BANDS, ROWS = 32, 2
_POSITION_BITS = np.uint64(28)
_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Buckets of the table that orders words by their count.
COUNT_BITS = 20
#: Words before a key, in the order of rareness, by which pairs that met already are told.
EARLIER = 16
#: Keys in one batch at most.
KEY_ROWS = 20_000
#: Texts of a very common key word in one block of its cells.
CROWD = 1000
#: Texts of the exact rest in one task.
REST_ROWS = 1000
#: Spark's own limit on a table's buckets; beyond it buckets grow, and their rows stream through the joins.
MOST_BUCKETS = 100_000


def occurrences(values: np.ndarray) -> np.ndarray:
    """0 for a value's first occurrence, 1 for its second, and so on."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    fresh = np.concatenate(([True], v[1:] != v[:-1]))
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(v)), 0))
    out = np.empty(len(v), dtype=np.int64)
    out[order] = np.arange(len(v)) - start
    return out


def labelled(values: np.ndarray) -> np.ndarray:
    return mix(values + occurrences(values).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def signatures(words: np.ndarray) -> np.ndarray:
    """The BANDS order-MinHash signatures of a text with at least one word."""
    kmers = labelled(shingle_hashes(words))
    at = np.arange(len(kmers), dtype=np.uint64)
    best = []
    for i in range(0, len(kmers), 16384):
        h = (kmers[i : i + 16384, None] ^ _XOR) * _MUL
        h = (h >> _POSITION_BITS << _POSITION_BITS) | at[i : i + 16384, None]
        first = h.min(axis=0)
        best.append(first)
        if len(h) > 1:
            h[h.argmin(axis=0), np.arange(h.shape[1])] = np.iinfo(np.uint64).max
            best.append(h.min(axis=0))
    two = np.sort(np.array(best), axis=0)[:2]
    pos = np.sort(two & np.uint64((1 << 28) - 1), axis=0).astype(np.int64)  # text order
    kept = kmers[pos]
    tuple_hash = mix(kept[0] + (mix(kept[1]) if len(kept) > 1 else np.uint64(1)))
    pairs = tuple_hash.reshape(BANDS, ROWS)
    return mix(pairs[:, 0] + mix(pairs[:, 1]) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def banded_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences within a band of ``most`` diagonals each way; most + 1 if it is larger.

    The band's column of vertical differences is kept as two bit vectors and moves down
    one row with each element of ``b`` (bit-parallel alignment).
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    t = min(most, n)
    width = 2 * t + 2
    mask = (1 << width) - 1
    up, down = ((1 << (t + 1)) - 1) << (width - t - 1), 0
    diagonal, horizontal = 1 << (width - 1), 1 << (width - 2)
    dist, low, worst = t, t + 1 - width, t + m - (n - t)
    where: dict[int, tuple[int, int]] = {}
    for i in range(min(t, n)):
        bits, base = where.get(a[i], (0, low))
        where[a[i]] = bits | 1 << (i - base), base
    for i in range(m):
        if t + i < n:
            bits, base = where.get(a[t + i], (0, low))
            where[a[t + i]] = bits >> (low - base) | 1 << (t + i - low), low
        bits, base = where.get(b[i], (0, low))
        x = bits >> (low - base) & mask
        d0 = ((((x & up) + up) ^ up) | x | down) & mask
        plus = (down | ~(d0 | up)) & mask
        minus = d0 & up
        if i < n - t:
            dist += not d0 & diagonal
        else:
            dist += bool(plus & horizontal) - bool(minus & horizontal)
            horizontal >>= 1
        if dist > worst:
            return most + 1
        up = (minus | ~((d0 >> 1) | plus)) & mask
        down = (d0 >> 1) & plus
        low += 1
    return dist if dist <= most else most + 1


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two word sequences align with a similarity of ``least`` or more."""
    longer = max(len(a), len(b))
    most = int((1.0 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    # The distance is at least the words that the other text lacks.
    values, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    ca, cb = np.bincount(inverse[: len(a)], minlength=len(values)), np.bincount(inverse[len(a) :], minlength=len(values))
    if longer - np.minimum(ca, cb).sum() > most:
        return False
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b, short = a[head:], b[head:], short - head
    differ = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    tail = int(differ[0]) if len(differ) else short
    x, y = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    band = min(most, 16)
    while True:
        if banded_distance(x, y, band) <= band:
            return True
        if band >= most:
            return False
        band = min(most, band * 4)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        ids, keys, sigs, words = [], [], [], []
        for doc, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            w = word_hashes(text.encode())
            if len(w):
                ids.append(doc)
                keys.append(key)
                sigs.append(signatures(w))
                words.append(squeeze.compress(w.astype("<u4").tobytes()))
        if ids:
            flat = pa.array(np.concatenate(sigs))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), lists, pa.array(words, pa.binary())], names=["id", "key", "sigs", "words"])


@lru_cache(maxsize=256)
def _words(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype="<u4")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ok = [similar(_words(x), _words(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        kept = [(x, y) for x, y, good in zip(a, b, ok) if good]
        if kept:
            x, y = zip(*kept)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])


def _linked(pairs: DataFrame, nodes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose texts are similar.

    Words come from the bucketed table where they lie; what is shuffled is the words of pairs only.
    A popular b meets one row, and both sides of that join are shuffled, so AQE can split it.
    """
    left = nodes.join(pairs.hint("shuffle_hash"), nodes.id == pairs.a).select("a", "b", F.col("words").alias("wa"))
    asked = pairs.select(F.col("b").alias("n")).distinct()
    right = nodes.join(asked.hint("shuffle_hash"), nodes.id == asked.n).select("n", F.col("words").alias("wb"))
    right = right.repartition("n")
    both = left.repartition("b").join(right.hint("merge"), left.b == right.n)
    return scratch.save(both.select("a", "b", "wa", "wb").mapInArrow(_verify, "a long, b long"), name)


def _rare_keys(counts):
    """mapInArrow function: each text's rarest words, as many as any similar text must share one of.

    A row a word that another text may have: its rank in the order of rareness and the EARLIER words before it.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in batches:
            for doc, comp, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                w = _words(data)
                token = labelled(w.astype(np.uint64))
                n = len(w) - int(np.ceil(SIMILARITY * len(w) - 1e-9)) + 1
                count = table[w & np.uint32((1 << COUNT_BITS) - 1)]
                order = np.lexsort((token, count))[:n]
                rare = token[order].view(np.int64)
                # A word that stands once in all these texts is in no other: it keeps its rank and is no key.
                shared = np.flatnonzero(count[order] > 1)
                for lo in range(0, len(shared), KEY_ROWS):
                    at = shared[lo : lo + KEY_ROWS]
                    have = np.minimum(at, EARLIER)
                    ends = np.cumsum(np.concatenate(([0], have))).astype(np.int32)
                    earlier = rare[np.arange(ends[-1]) - np.repeat(ends[:-1], have) + np.repeat(at - have, have)]
                    fixed = [pa.array(np.full(len(at), x, dtype=np.int64)) for x in (doc, comp, len(w))]
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(earlier))
                    yield pa.RecordBatch.from_arrays([pa.array(rare[at]), *fixed, pa.array(at), lists], names=["token", "id", "comp", "size", "rank", "earlier"])

    return keys


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << COUNT_BITS, dtype=np.int64)
    for batch in batches:
        for data in batch.column(0).to_pylist():
            total += np.bincount(_words(data) & np.uint32((1 << COUNT_BITS) - 1), minlength=1 << COUNT_BITS) if len(data) > 1 << 20 else 0
            if len(data) <= 1 << 20:
                at, n = np.unique(_words(data) & np.uint32((1 << COUNT_BITS) - 1), return_counts=True)
                total[at] += n
    at = np.flatnonzero(total)
    for i in range(0, len(at), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 50_000]), pa.array(total[at[i : i + 50_000]])], names=["bucket", "n"])


def _crowds(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of texts that share a key word and may be similar, b the lesser id.

    A word's texts are dealt into blocks of about CROWD; a cell holds two blocks, so no
    task holds all texts of a very common word. Pairs of one block meet in its own cell only.
    """
    crowd = keys.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    crowd = crowd.select(F.col("token").alias("t"), F.ceil(F.col("n") / CROWD).alias("blocks"))
    dealt = keys.join(crowd, keys.token == crowd.t).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("token", "id", "comp", "size", "rank", "earlier", "block", F.least("block", "other").alias("c1"), F.greatest("block", "other").alias("c2"))
    dealt = scratch.save(dealt, "omh-cells")
    x, y = dealt.alias("x"), dealt.alias("y")
    cell = (F.col("x.token") == F.col("y.token")) & (F.col("x.c1") == F.col("y.c1")) & (F.col("x.c2") == F.col("y.c2"))
    cell &= (F.col("x.c1") == F.col("x.c2")) | (F.col("x.block") != F.col("y.block"))
    left = F.least(F.col("x.size") - F.col("x.rank"), F.col("y.size") - F.col("y.rank"))  # words of each from this one on
    close = (F.col("x.id") > F.col("y.id")) & (F.col("x.comp") != F.col("y.comp")) & (left >= SIMILARITY * F.greatest("x.size", "y.size") - 1e-9)
    close &= ~F.arrays_overlap("x.earlier", "y.earlier")
    return x.join(y, cell & close).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct (doc_id, text): doc_id, text_md5, class_id. Two columns of the result are durable, the rest is dropped."""
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "omh")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("key"), F.col(text_col).alias("text"))
    made = rows.where("id is not null and text is not null").mapInArrow(_sketch, "id long, key binary, sigs array<long>, words binary")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, parts_for(total_chars(docs, text_col), 64_000_000, 1)))
    # The one shuffle of all texts' words: later joins on the id find them in place.
    sketched = scratch.save_bucketed(made.repartition(buckets, "id").dropDuplicates(["id", "key"]), "sketches", "id", buckets)

    first = scratch.save(sketched.groupBy("key").agg(F.min("id").alias("node")), "texts")
    own = first.groupBy(F.col("node").alias("own")).agg(F.collect_set("key").alias("keys"))
    own = scratch.save_bucketed(own, "nodes", "own", buckets)
    nodes = sketched.join(own.hint("shuffle_hash"), sketched.id == own.own).where(F.array_contains("keys", F.col("key"))).select("id", "sigs", "words")

    bands = nodes.select("id", F.posexplode("sigs").alias("band", "sig")).select("id", F.xxhash64("band", "sig").alias("sig"))
    heads = bands.groupBy("sig").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = scratch.save(bands.join(heads.select("sig", "head"), "sig"), "shared")
    scratch.release()
    star = shared.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    links = _linked(scratch.save(star, "star"), nodes, scratch, "links")
    scratch.drop("star")
    comps = connected_components(links, scratch=scratch)

    # Buckets that are in several components still: their members go to the exact rest.
    named = shared.join(comps, shared.id == comps.node, "left").select("sig", "id", F.coalesce("comp", "id").alias("comp"))
    open_ = named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig")
    rest = scratch.save(named.join(open_, "sig", "left_semi").select("id", "comp").distinct(), "open")
    scratch.drop("shared")
    scratch.release()
    rest = rest.select(F.col("id").alias("r"), "comp")
    # Few texts remain here as a rule: a task has about REST_ROWS of them, not one bucket's share.
    rest_words = nodes.join(rest.hint("shuffle_hash"), nodes.id == rest.r).select("id", "comp", "words")
    rest_words = rest_words.coalesce(max(1, -(-rest.count() // REST_ROWS)))
    sums = rest_words.select("words").mapInArrow(_word_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(1 << COUNT_BITS, dtype=np.int64)  # 8 MiB, whatever the corpus
    table[sums["bucket"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy(dtype=np.int64)
    keys = rest_words.mapInArrow(_rare_keys(spark.sparkContext.broadcast(table)), "token long, id long, comp long, size long, rank long, earlier array<long>")
    more = scratch.save(_crowds(scratch.save(keys, "rare"), scratch), "pairs")
    scratch.drop("open", "rare", "omh-cells")
    scratch.release()
    more = _linked(more, nodes, scratch, "more")
    scratch.drop("pairs")
    if more.limit(1).count():
        comps = connected_components(links.union(more), scratch=scratch)

    of_text = first.join(comps, first.node == comps.node, "left").select(F.col("key").alias("k"), F.coalesce(comps.comp, first.node).alias("class_id"))
    every = rows.select("id", "key").distinct()
    found = every.join(of_text, every.key == of_text.k, "left")
    found = scratch.save(found.select(F.col("id").alias("doc_id"), F.col("key").alias("text_md5"), F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id")), "classes")
    scratch.drop("sketches", "texts", "nodes", "links", "more", "cc-links", "cc-labels")
    scratch.release()
    return found


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class: that with the class's id. Rows without an id stay.

    Of several texts under the class's id the one with the least MD5 stays; of rows equal in id and text one.
    """
    docs, (id_col, text_col), names = shielded(docs, id_col, text_col)
    found = classes(docs, id_col, text_col).where("doc_id = class_id").groupBy("doc_id").agg(F.min(F.coalesce("text_md5", F.lit(b""))).alias("_key")).withColumnRenamed("doc_id", "_id")
    rows = docs.where(F.col(id_col).isNotNull()).withColumn("_at", F.col(id_col).cast("long"))
    # The texts are shuffled once, by id: the choice of the text and of one row follow in place.
    kept = rows.join(found.hint("shuffle_hash"), F.col("_at") == F.col("_id"))
    kept = kept.where(F.coalesce(F.unhex(F.md5(F.col(text_col).cast("binary"))), F.lit(b"")) == F.col("_key")).dropDuplicates(["_at"])
    return kept.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull())).toDF(*names)
