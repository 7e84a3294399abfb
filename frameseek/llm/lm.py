"""Language-model scoring: a log-bilinear model over words, trained by noise-contrastive estimation.

The model's units are words: the most frequent training words are units of their own, and
their number grows with the square root of the corpus. A rarer word shares the unit of its
last two bytes (again a number that grows) or a common rest; within such a unit a word has
its smoothed training frequency, with room for unseen words.

A token's context vector combines the vectors of the two units before it linearly and is
matched with the vectors of what may follow (log-bilinear). The softmax is in two steps:
units lie in about sqrt(units) clusters, P(unit) = P(cluster) * P(unit in cluster), each
step normalised exactly over its members by a batched matrix product, so the probabilities
of all words, known or not, sum to 1. Both steps are trained in numpy with noise-contrastive
estimation, the noise being the unigram frequencies of clusters, or of units in the target's
cluster, by its expectation. A start is trained on trigrams drawn evenly from all training
tokens; then tasks pass once over every trigram of every training document, and what they
learnt is averaged row by row. A block's equal trigrams are learnt and scored as one with
their number, and what a context is told of its noise is summed once for all that follow it.
What the driver receives grows with the square root of the corpus.

Words of a text are maximal runs without ASCII white space, A-Z lower-cased; one end
token follows. Defined results: a null text is the empty text (its end token only).
Without training documents, all counts are 0. Repeated rows are scored each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameseek.llm import wordtable as wt
from frameseek.llm.common import Scratch, parts_for, prepare, total_chars

#: Own units, and drawn trigrams, for the square root of the corpus' words (six characters each).
OWN_RATE, DRAW_RATE = 2.0, 256.0
#: Tokens whose scores are computed at once.
CHUNK = 1 << 16
#: Distinct trigrams in one step of the pass over all, and rows of the model averaged at once.
BATCH, ROWS = 1 << 15, 4096
#: Of the pass: speed, what AdaGrad has seen at first, noise a token; rows whose noise is in memory at once.
RATE, SEEN, NOISE, STRETCH = 0.1, 1e-7, 8, 1 << 10
#: Characters in one block of documents.
BLOCK_CHARS = 16_000_000
#: The bits of 1.0 as a 32-bit float, and half a natural logarithm in the bits of such floats.
UNIT_BITS, HALF = 127 << 23, 0.5 * (1 << 23) / math.log(2)
SCHEMA = "doc_id long, n_tokens long, n_known long, base_score double, score double, flag boolean"


@dataclass
class Vocabulary:
    """Units in order of their number (own words, endings, rest, end) and what the training documents hold of each."""

    own: dict[bytes, int]
    endings: dict[bytes, int]
    mass: np.ndarray
    types: np.ndarray
    tokens: int
    distinct: int
    documents: int

    @property
    def rest(self) -> int:
        return len(self.mass) - 2

    @property
    def end(self) -> int:
        return len(self.mass) - 1

    @property
    def start(self) -> int:
        """What stands before a text; never predicted."""
        return len(self.mass)

    def units(self, words: list[bytes]) -> np.ndarray:
        own, endings, rest = self.own, self.endings, self.rest
        return np.fromiter((own[w] if w in own else endings.get(w[-2:], rest) for w in words), dtype=np.int64, count=len(words))


def _count_part(most: int):
    def handle(bundles: list[tuple[int, list[bytes], np.ndarray]]) -> Iterator[tuple[int, int | None, bytes]]:
        """Corpus counts of the part's words back to each block; the part's own sums go out as part -2."""
        total: dict[bytes, int] = {}
        for _, words, counts in bundles:
            for w, n in zip(words, counts.tolist()):
                total[w] = total.get(w, 0) + n
        for block, words, _ in bundles:
            yield block, None, wt.pack((words, np.fromiter((total[w] for w in words), dtype=np.int64, count=len(words))))
        seen = {w: n for w, n in total.items() if n}
        ends: dict[bytes, list[int]] = {}
        for w, n in seen.items():
            e = ends.setdefault(w[-2:], [0, 0])
            e[0] += n
            e[1] += 1
        yield -1, -2, wt.pack((sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:most], ends))

    return handle


def _part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for data in batch.column(0).to_pylist():
            top, ends = wt.unpack(data)
            rows += [(True, w, n, 1) for w, n in top] + [(False, e, m, t) for e, (m, t) in ends.items()]
        if rows:
            kinds = (pa.bool_(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=["own", "key", "mass", "types"])


def vocabulary(resolved: DataFrame, documents: int, most: int) -> Vocabulary:
    """Choose the units from the parts' sums: ``most`` words and a quarter as many endings have their own."""
    rows = resolved.where("part = -2").select("data").mapInArrow(_part_rows, "own boolean, key binary, mass long, types long")
    own = rows.where("own").orderBy(F.desc("mass"), "key").limit(most).collect()
    ends = rows.where("not own").groupBy("key").agg(F.sum("mass").alias("mass"), F.sum("types").alias("types"))
    sums = ends.agg(F.coalesce(F.sum("mass"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    words = {bytes(r["key"]): i for i, r in enumerate(own)}
    # Endings are bytes pairs or single bytes: 65,792 at most. Those of own words lose their share below.
    left = {bytes(r["key"]): [r["mass"], r["types"]] for r in ends.collect()}
    for r in own:
        e = left[bytes(r["key"])[-2:]]
        e[0] -= r["mass"]
        e[1] -= 1
    ranked = sorted((e for e in left if left[e][0]), key=lambda e: (-left[e][0], e))[: max(1, most // 4)]
    endings = {e: len(words) + i for i, e in enumerate(ranked)}
    n = len(words) + len(endings) + 2
    mass, types = np.zeros(n), np.zeros(n)
    for r in own:
        mass[words[bytes(r["key"])]], types[words[bytes(r["key"])]] = r["mass"], 1
    for e, (m, t) in left.items():
        mass[endings.get(e, n - 2)] += m
        types[endings.get(e, n - 2)] += t
    mass[n - 1], types[n - 1] = documents, float(documents > 0)
    return Vocabulary(words, endings, mass, types, int(sums[0]) + documents, int(sums[1]) + (documents > 0), documents)


def _slot_units(vocab: Vocabulary, block: wt.Block, words: list[list[bytes]]) -> np.ndarray:
    flat = [w for some in words for w in some]
    return vocab.units(flat)[block.slots()] if flat else np.empty(0, dtype=np.int64)


def _sequences(block: wt.Block, per_rank: np.ndarray, end: float, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values of all tokens with each document's end token in place; where each document's run ends."""
    ends = np.cumsum(block.lens.astype(np.int64) + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=dtype)
    is_end = np.zeros(len(out), dtype=bool)
    is_end[ends - 1] = True
    out[is_end] = end
    out[~is_end] = per_rank[block.codes]
    return out, ends


def _histories(units: np.ndarray, ends: np.ndarray, lens: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Units one and two tokens back, ``start`` before a document's first token."""
    one, two = np.concatenate(([start], units[:-1])), np.concatenate(([start, start], units[:-2]))[: len(units)]
    first = ends - lens - 1
    one[first] = start
    two[first] = start
    second = first[lens > 0] + 1
    two[second] = start
    return one[: len(units)], two


def draws(joined: DataFrame, vocab: Vocabulary, wanted: int) -> np.ndarray:
    """About ``wanted`` trigrams of units (two back, one back, next), drawn evenly from all training tokens."""
    shared = joined.sparkSession.sparkContext.broadcast(vocab)
    rate = min(1.0, wanted / max(vocab.tokens, 1))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, answers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block, v = wt.read_block(docs), shared.value
                units, ends = _sequences(block, _slot_units(v, block, [wt.unpack(a)[0] for a in answers]), v.end, np.int64)
                one, two = _histories(units, ends, block.lens, v.start)
                # The block's own lengths seed its draw, so a task that runs again draws the same.
                chance = np.random.default_rng(np.append(block.lens[:64], len(units))).random(len(units))
                use = np.repeat(block.flags, block.lens + 1) & (chance < rate)
                got = np.column_stack((two[use], one[use], units[use])).astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array([got.tobytes()], pa.binary())], names=["data"])

    rows = joined.select("docs", "answers").mapInArrow(draw, "data binary").collect()
    got = [np.frombuffer(r["data"], dtype="<i4").reshape(-1, 3) for r in rows]
    got = np.concatenate(got) if got else np.empty((0, 3), dtype=np.int32)
    return got[np.lexsort(got.T)]


@dataclass
class Model:
    """The trained parameters: unit vectors already turned by their place's matrix, cluster and unit vectors, biases."""

    one: np.ndarray
    two: np.ndarray
    clusters: np.ndarray
    cluster_bias: np.ndarray
    units: np.ndarray
    unit_bias: np.ndarray
    size: int  # units in a cluster

    def log10(self, two: np.ndarray, one: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Normalised log10 P(unit | two units before) of many tokens; equal trigrams are scored once."""
        two, one, unit, which = _distinct(two, one, unit, len(self.one))
        out = np.empty(len(unit))
        for at in range(0, len(unit), CHUNK):
            out[at : at + CHUNK] = self._logs(two[at : at + CHUNK], one[at : at + CHUNK], unit[at : at + CHUNK])
        return (out / np.log(10.0))[which]

    @np.errstate(over="ignore", invalid="ignore")  # what leaves 32 bits is summed anew
    def _logs(self, two: np.ndarray, one: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Of sorted trigrams: a context's clusters are summed once, and a cluster's units once a context."""
        home = unit // self.size
        new = _changes(two) | _changes(one)
        pair = new | _changes(home)
        context = np.cumsum(new) - 1
        p = np.ones((np.count_nonzero(new), self.one.shape[1] + 1), dtype=np.float32)
        p[:, :-1] = self.one[one[new]] + self.two[two[new]]
        total = self._log_clusters(p, one[new], two[new])
        of, at = context[pair], home[pair]
        inside = np.empty(len(at), dtype=np.float32)
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(len(self.clusters) + 1))
        for c in np.flatnonzero(np.diff(cuts)).tolist():
            rows, some = order[cuts[c] : cuts[c + 1]], slice(c * self.size, (c + 1) * self.size)
            inside[rows] = _log_sum(p[of[rows]], self.units[some], self.unit_bias[some])
        chosen = np.einsum("bd,bd->b", p[context, :-1], self.clusters[home] + self.units[unit]) + self.cluster_bias[home] + self.unit_bias[unit]
        return chosen.astype(np.float64) - total[context] - inside[np.cumsum(pair) - 1]

    def _log_clusters(self, p: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Log of the clusters' sum for each context ``p``: the exponentials of its two units' parts, taken once a unit, are multiplied."""
        (a, of_a), (b, of_b) = (np.unique(x, return_inverse=True) for x in (one, two))
        left, right = np.exp(self.one[a] @ self.clusters.T + self.cluster_bias), np.exp(self.two[b] @ self.clusters.T)
        total = np.empty(len(p), dtype=np.float32)
        for lo in range(0, len(p), STRETCH):
            some = slice(lo, lo + STRETCH)
            total[some] = np.einsum("bk,bk->b", left[of_a[some]], right[of_b[some]])
        odd = np.flatnonzero(~((total > 1e-30) & (total < 1e30)))  # too small or large for 32 bits
        total[odd] = 1
        np.log(total, out=total)
        total[odd] = _log_sum(p[odd], self.clusters, self.cluster_bias)
        return total

    def tables(self) -> dict[str, np.ndarray]:
        """The parameters as tables of rows, without copies."""
        return {"one": self.one, "two": self.two, "clusters": self.clusters, "cluster_bias": self.cluster_bias[:, None], "units": self.units, "unit_bias": self.unit_bias[:, None]}


def _changes(x: np.ndarray) -> np.ndarray:
    return np.concatenate((np.ones(min(len(x), 1), dtype=bool), x[1:] != x[:-1]))


def _distinct(two: np.ndarray, one: np.ndarray, unit: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams in order, and which of them each given one is."""
    key = (two.astype(np.int64) * base + one) * base + unit
    order = np.argsort(key)
    key = key[order]
    new = _changes(key)
    which = np.empty(len(key), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    context, unit = np.divmod(key[new], base)
    return *np.divmod(context, base), unit, which


def _log_sum(p: np.ndarray, vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Log of the summed exponentials of ``p @ vectors.T + bias``; ``p`` ends with a column of ones."""
    against = np.column_stack((vectors, bias)).T
    s = p @ against
    np.exp(s, out=s)
    total = s @ np.ones(s.shape[1], dtype=np.float32)
    odd = np.flatnonzero(~((total > 1e-30) & (total < 1e30)))  # too small or large for 32 bits
    total[odd] = 1
    np.log(total, out=total)
    if len(odd):
        s = p[odd] @ against
        most = s.max(axis=1)
        total[odd] = np.log(np.exp(s - most[:, None]).sum(axis=1)) + most
    return total


def _logistic(s: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(s)) of ``HALF`` times s, its odds within 1 %: exp(s) is e(s / 2) / e(-s / 2), e linear between powers of 2."""
    np.minimum(s, 126 << 23, out=s)
    np.maximum(s, -126 << 23, out=s)
    up = s.astype(np.int32)
    down = (UNIT_BITS - up).view(np.float32)
    up += UNIT_BITS
    up = up.view(np.float32)
    up += down
    return np.divide(down, up, out=down)


def _add(x: np.ndarray, past: np.ndarray, at: np.ndarray, d: np.ndarray, rate: float) -> None:
    """One AdaGrad step on the rows ``at`` of ``x``, repeated rows summed."""
    order = np.argsort(at, kind="stable")
    rows, first = np.unique(at[order], return_index=True)
    g = np.add.reduceat(d[order], first, axis=0)
    past[rows] += g * g
    x[rows] -= rate * g / np.sqrt(past[rows])


def nce(trigrams: np.ndarray, mass: np.ndarray, width: int = 24, batch: int = 8192, epochs: int = 5, rate: float = 0.4, seed: int = 5) -> Model:
    """Train on (two back, one back, next) rows; ``mass``: training tokens of each unit."""
    rng, n = np.random.default_rng(seed), len(mass)
    size = max(1, round(n**0.5))
    of = np.arange(n) // size
    share = (mass + 0.5) / (mass + 0.5).sum()
    p_home = np.bincount(of, weights=share)
    one, two, clusters, units = (rng.normal(0, s, (k, width)).astype(np.float32) for k, s in ((n + 1, 0.1), (n + 1, 0.05), (len(p_home), 0.1), (n, 0.1)))
    model = Model(one, two, clusters, np.log(p_home).astype(np.float32), units, np.log(share / p_home[of]).astype(np.float32), size)
    run = Pass(model, mass)
    two, one, unit, which = _distinct(*trigrams.T.astype(np.int64), n + 1)
    count, some = np.bincount(which, minlength=len(unit)), min(batch, max(256, len(unit) // 128))
    for epoch in range(epochs):
        run.learn(two, one, unit, count, some, rate * 0.1 ** (epoch / max(1, epochs - 1)))
    return run.model()


class Pass:
    """A way through trigrams from a given model: the start's, or a task's from the model that all tasks share."""

    def __init__(self, start: Model, mass: np.ndarray) -> None:
        self.start, self.size = start, start.size
        self.now = {k: x.copy() for k, x in start.tables().items()}
        self.seen = {k: np.full(x.shape, SEEN, dtype=np.float32) for k, x in self.now.items()}
        self.weight = {k: np.zeros(len(x)) for k, x in self.now.items()}
        share = (mass + 0.5) / (mass + 0.5).sum()
        of = np.arange(len(mass)) // self.size
        self.p_home = np.bincount(of, weights=share, minlength=len(start.clusters)).astype(np.float32)
        self.p_unit = (share / self.p_home[of]).astype(np.float32)
        self.rng = np.random.default_rng(7)

    def _head(self, p, weight, noise, names, rows, at, column, share, rate) -> np.ndarray:
        """Tell the true ones (``column`` of context ``at``, by ``share``) from noise, which all columns are by their share; the contexts' gradient comes back.

        ``p`` ends with a column of ones, for the bias. A true one is (1 - g) less in place of g more, in the same two products.
        """
        x, bias = (self.now[k][rows] for k in names)
        often, width = (NOISE * noise)[:, None], x.shape[1]
        against = np.column_stack((x, bias - np.log(often)))
        against *= np.float32(-HALF)
        pulled, told = x * often, p * weight[:, None]
        back, d = np.empty((len(p), width), dtype=np.float32), np.zeros((len(x), width + 1), dtype=np.float32)
        true = share / (weight[at] * often[column, 0])
        cuts = np.searchsorted(at, np.arange(0, len(p) + STRETCH, STRETCH))
        for k, lo in enumerate(range(0, len(p), STRETCH)):
            some, here = slice(lo, lo + STRETCH), slice(cuts[k], cuts[k + 1])
            g = _logistic(p[some] @ against.T)
            spot = at[here] - lo, column[here]
            g[spot] -= (1 - g[spot]) * true[here]
            np.matmul(g, pulled, out=back[some])
            d += g.T @ told[some]
        d *= often
        back *= weight[:, None]
        for k, part in zip(names, (d[:, :width], d[:, width:])):
            self.seen[k][rows] += part * part
            self.now[k][rows] -= rate * part / np.sqrt(self.seen[k][rows])
        return back

    def learn(self, two: np.ndarray, one: np.ndarray, unit: np.ndarray, count: np.ndarray, batch: int | None = None, rate: float = RATE) -> None:
        """Steps of AdaGrad on about ``batch`` of the sorted distinct trigrams, each by its number; a context's are in one step."""
        home = unit // self.size
        for k, at in (("two", two), ("one", one), ("clusters", home), ("units", unit)):
            self.weight[k] += np.bincount(at, weights=count, minlength=len(self.weight[k]))
        first = np.flatnonzero(_changes(two) | _changes(one))
        follow = np.diff(np.append(first, len(unit)))
        order = self.rng.permutation(len(first))
        cuts = np.append(np.flatnonzero(_changes(np.cumsum(follow[order]) // (batch or BATCH))), len(order))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            c = np.sort(order[lo:hi])
            n = follow[c]
            context = np.repeat(np.arange(len(c)), n)
            some = np.arange(len(context)) + np.repeat(first[c] - (np.cumsum(n) - n), n)
            u, h, w = unit[some], home[some], count[some].astype(np.float32)
            w /= w.sum()
            # A context's units in one cluster: they share the noise of that cluster.
            new = np.flatnonzero(_changes(context) | _changes(h))
            of, where, share = context[new], h[new], np.add.reduceat(w, new)
            begin = np.flatnonzero(_changes(of))
            p = np.ones((len(c), self.now["one"].shape[1] + 1), dtype=np.float32)
            p[:, :-1] = self.now["one"][one[first[c]]] + self.now["two"][two[first[c]]]
            back = self._head(p, np.add.reduceat(share, begin), self.p_home, ("clusters", "cluster_bias"), slice(None), of, where, share, rate)
            by = np.argsort(where, kind="stable")
            place = np.empty(len(by), dtype=np.int64)
            place[by] = np.arange(len(by))
            at = place[np.repeat(np.arange(len(new)), np.diff(np.append(new, len(u))))]
            by_at = np.argsort(at, kind="stable")
            at, column, w = at[by_at], (u - h * self.size)[by_at], w[by_at]
            bounds = np.searchsorted(where[by], np.arange(len(self.p_home) + 1))
            inner, share, of = np.empty((len(by), back.shape[1]), dtype=np.float32), share[by], of[by]
            ends = np.searchsorted(at, bounds)
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                rows, here, members = slice(bounds[k], bounds[k + 1]), slice(ends[k], ends[k + 1]), slice(k * self.size, (k + 1) * self.size)
                inner[rows] = self._head(p[of[rows]], share[rows], self.p_unit[members], ("units", "unit_bias"), members, at[here] - bounds[k], column[here], w[here], rate)
            back += np.add.reduceat(inner[place], begin, axis=0)
            _add(self.now["one"], self.seen["one"], one[first[c]], back, rate)
            _add(self.now["two"], self.seen["two"], two[first[c]], back, rate)

    def model(self) -> Model:
        now = self.now
        return Model(now["one"], now["two"], now["clusters"], now["cluster_bias"][:, 0], now["units"], now["unit_bias"][:, 0], self.size)

    def learnt(self) -> Iterator[tuple[str, int, bytes, bytes]]:
        """Rows' changes by the weight of what they were learnt from, and those weights."""
        old = self.start.tables()
        for k, x in self.now.items():
            w = self.weight[k.replace("_bias", "s")] if k.endswith("_bias") else self.weight[k]
            for lo in range(0, len(x), ROWS):
                part = w[lo : lo + ROWS].astype(np.float32)
                yield k, lo, ((x[lo : lo + ROWS] - old[k][lo : lo + ROWS]) * part[:, None]).astype(np.float32).tobytes(), part.tobytes()


def _mean(tbl: pa.Table) -> pa.Table:
    """The mean change of a stretch of rows, each task's by its weight."""
    weight = sum(np.frombuffer(w, dtype=np.float32).astype(np.float64) for w in tbl.column("weight").to_pylist())
    change = sum(np.frombuffer(d, dtype=np.float32).reshape(len(weight), -1).astype(np.float64) for d in tbl.column("data").to_pylist())
    change /= np.maximum(weight, 1e-9)[:, None]
    return pa.table({"name": tbl.column("name")[:1], "at": tbl.column("at")[:1], "data": pa.array([change.astype(np.float32).tobytes()], pa.binary())})


def learn_all(joined: DataFrame, vocab: Vocabulary, model: Model, tasks: int) -> None:
    """Passes once over every trigram of the training documents, in ``tasks`` tasks, and brings ``model`` to their mean."""
    shared = joined.sparkSession.sparkContext.broadcast((vocab, model))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = shared.value
        run = Pass(m, v.mass)
        for batch in batches:
            for docs, answers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block = wt.read_block(docs)
                units, ends = _sequences(block, _slot_units(v, block, [wt.unpack(a)[0] for a in answers]), v.end, np.int64)
                one, two = _histories(units, ends, block.lens, v.start)
                use = np.repeat(block.flags, block.lens + 1)
                two, one, units, which = _distinct(two[use], one[use], units[use], len(m.one))
                run.learn(two, one, units, np.bincount(which, minlength=len(units)))
        for name, at, data, weight in run.learnt():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), pa.array([data], pa.binary()), pa.array([weight], pa.binary())], names=["name", "at", "data", "weight"])

    rows = joined.select("docs", "answers").coalesce(tasks).mapInArrow(learn, "name string, at long, data binary, weight binary")
    tables = model.tables()
    for r in rows.groupBy("name", "at").applyInArrow(_mean, "name string, at long, data binary").collect():
        x = tables[r["name"]]
        x[r["at"] : r["at"] + ROWS] += np.frombuffer(r["data"], dtype=np.float32).reshape(-1, x.shape[1])
    shared.unpersist()


def score(docs: DataFrame, flag_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every whole text, learning from the rows where ``flag_col`` is true. Adds train_tokens."""
    spark = prepare(docs.sparkSession)
    chars = total_chars(docs, text_col)
    parts, root = parts_for(chars), math.sqrt(chars / 6)
    most, scratch = max(16, int(OWN_RATE * root)), Scratch(spark, "lm")
    blocks = scratch.save(wt.build_blocks(docs, id_col, text_col, wt.split_ascii_lower, parts, flag_col, BLOCK_CHARS), "blocks")
    documents = docs.where(F.col(flag_col)).count()
    resolved = scratch.save(wt.resolve(blocks, _count_part(most), parts), "counts")
    vocab = vocabulary(resolved, documents, most)
    answers = resolved.where("part >= 0").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "data"))).alias("a"))
    joined = blocks.where("part = -1").select("block", F.col("data").alias("docs")).join(answers, "block", "left")
    joined = scratch.save(joined.select("docs", F.coalesce(F.transform("a", lambda x: x["data"]), F.array().cast("array<binary>")).alias("answers")), "joined")
    scratch.drop("blocks", "counts")
    scratch.release()
    model = nce(draws(joined, vocab, int(DRAW_RATE * root)), vocab.mass)
    if vocab.tokens > int(DRAW_RATE * root):  # else the start was trained on all trigrams
        learn_all(joined, vocab, model, max(12, int(root / 500)))
    shared = spark.sparkContext.broadcast((vocab, model))  # two vectors a unit

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = shared.value
        room = v.tokens + 0.5 * (v.distinct + 1)
        for batch in batches:
            for docs_data, answer in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block = wt.read_block(docs_data)
                got = [wt.unpack(a) for a in answer]
                per_unit = _slot_units(v, block, [g[0] for g in got])
                c = np.concatenate([g[1] for g in got] or [np.empty(0, dtype=np.int64)])[block.slots()]
                del got
                base = np.log10((c + 0.5) / room)
                alone = per_unit < len(v.own)
                within = np.where(alone, 0.0, np.log10((c + 0.5) / (v.mass[per_unit] + 0.5 * (v.types[per_unit] + 1))))
                units, ends = _sequences(block, per_unit, v.end, np.int64)
                one, two = _histories(units, ends, block.lens, v.start)
                first = ends - block.lens - 1
                total = np.add.reduceat(m.log10(two, one, units) + _sequences(block, within, 0.0, np.float64)[0], first)
                del one, two, units
                base = np.add.reduceat(_sequences(block, base, np.log10((v.documents + 0.5) / room), np.float64)[0], first)
                known = np.add.reduceat(_sequences(block, c > 0, v.documents > 0, np.int64)[0], first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids, pa.int64()), pa.array(block.lens.astype(np.int64) + 1), pa.array(known), pa.array(base), pa.array(total), pa.array(block.flags)],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score", "flag"],
                )

    return joined.mapInArrow(apply, SCHEMA).withColumn("train_tokens", F.lit(vocab.tokens).cast("long"))
