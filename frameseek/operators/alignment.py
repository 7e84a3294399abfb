"""Time-aware alignment of a question's events with candidate rows of a video, many videos at once.

Every candidate of the first event that has any is an anchor. From an anchor the chain goes on
through the events' candidates in rising time, no later than ``span`` after it; an event without
candidates, or without one that any open chain can reach, is passed over and its place stays
empty. Steps outside [near, far] cost in proportion to how far they are off. Of all anchors
the best chain stays. Candidates are padded to a cube (videos, events, candidates), so a batch
of videos is aligned by one pass of numpy over events, all anchors side by side.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The least and the largest step, in seconds, that cost nothing.
NEAR, FAR = 5.0, 56.0
#: Videos aligned at once: 64 videos of 20 candidates an event are 4 MB a matrix of steps.
TOGETHER = 64


def step_cost(dt: np.ndarray, near: float = NEAR, far: float = FAR) -> np.ndarray:
    """0 within [near, far]; the share that is missing below it, and that is too much above; a step must rise."""
    off = np.where(dt < near, (near - dt) / near if near > 0 else 0.0, np.where(dt > far, (dt - far) / far if math.isfinite(far) else 0.0, 0.0))
    return np.where(dt > 0, off, np.inf)


def align(ids: np.ndarray, times: np.ndarray, scores: np.ndarray, cost: float, near: float, far: float, span: float) -> tuple[np.ndarray, np.ndarray]:
    """(place of the chosen candidate or -1 for each video and event, chain scores); NaN scores are no candidates.

    The arguments are cubes (videos, events, candidates), candidates in order of preference: of equal chains the
    first candidate wins, from the last event backwards, then the first anchor.
    """
    v, n, k = scores.shape
    real = ~np.isnan(scores)
    some = real.any(axis=2)
    first = np.where(some.any(axis=1), some.argmax(axis=1), 0)
    rows = np.arange(v)
    usable = real[rows, first]  # (video, anchor)
    limit = times[rows, first] + span
    eye = np.where(np.eye(k, dtype=bool)[None], scores[rows, first][:, :, None], -np.inf)
    total = np.where(usable[:, :, None], eye, -np.inf)  # (video, anchor, candidate of the layer reached)
    layer = np.repeat(first[:, None], k, axis=1)
    back = np.full((n, v, k, k), -1, dtype=np.int16)
    came = np.full((n, v, k), -1, dtype=np.int16)
    for e in range(n):
        t, s = times[:, e], scores[:, e]
        reached = times[rows[:, None], layer]  # (video, anchor, candidate)
        step = t[:, None, :, None] - reached[:, :, None, :]
        open_ = np.isfinite(total)[:, :, None, :] & real[:, e][:, None, :, None] & (step > 0) & (t[:, None, :] <= limit[:, :, None])[..., None] & (e > first)[:, None, None, None]
        price = step_cost(np.where(open_, step, 1.0), near, far)
        with np.errstate(invalid="ignore"):
            value = total[:, :, None, :] + s[:, None, :, None] - cost * price
        value = np.where(open_, value, -np.inf)
        best = value.argmax(axis=3)
        new = np.take_along_axis(value, best[..., None], axis=3)[..., 0]
        goes = np.isfinite(new).any(axis=2)
        back[e] = np.where(np.isfinite(new), best, -1)
        came[e] = np.where(goes, layer, -1)
        total = np.where(goes[..., None], new, total)
        layer = np.where(goes, e, layer)
    ends = total.argmax(axis=2)
    value = np.take_along_axis(total, ends[..., None], axis=2)[..., 0]
    anchor = value.argmax(axis=1)
    score = value[rows, anchor]
    out = np.full((v, n), -1, dtype=np.int64)
    at, where = layer[rows, anchor], ends[rows, anchor]
    live = np.isfinite(score)
    while live.any():
        r = rows[live]
        out[r, at[live]] = where[live]
        before = came[at[live], r, anchor[live]]
        where[live] = back[at[live], r, anchor[live], where[live]]
        at[live] = before
        live = live & (at >= 0)
    return out, np.where(np.isfinite(score), score, np.nan)


def restart(ids: np.ndarray, times: np.ndarray, scores: np.ndarray, *_) -> tuple[np.ndarray, np.ndarray]:
    """As ``align`` without anchors, costs or a span: a candidate that no open chain reaches starts its chain anew.

    Of equal chains that one goes on which ended first, then the first candidate; likewise at the end.
    """
    v, n, k = scores.shape
    rows = np.arange(v)
    real = ~np.isnan(scores)
    total, at = np.full((v, k), -np.inf), np.zeros((v, k))
    layer = np.full(v, -1)
    back = np.full((n, v, k), -1, dtype=np.int16)
    came = np.full((n, v, k), -1, dtype=np.int16)

    def first_best(value: np.ndarray, when: np.ndarray) -> np.ndarray:
        best = value.max(axis=-1, keepdims=True)
        return np.where(value == best, when, np.inf).argmin(axis=-1)

    for e in range(n):
        open_ = np.isfinite(total)[:, None, :] & (at[:, None, :] < times[:, e][:, :, None])
        value = np.where(open_, total[:, None, :], -np.inf)
        best = first_best(value, np.broadcast_to(at[:, None, :], value.shape))
        before = np.take_along_axis(value, best[..., None], axis=2)[..., 0]
        follows = np.isfinite(before)
        new = np.where(real[:, e], np.where(follows, before, 0.0) + np.nan_to_num(scores[:, e]), -np.inf)
        some = real[:, e].any(axis=1)
        back[e], came[e] = np.where(follows, best, -1), np.where(follows, layer[:, None], -1)
        total, at = np.where(some[:, None], new, total), np.where(some[:, None], times[:, e], at)
        layer = np.where(some, e, layer)
    end = first_best(total, at)
    score = total[rows, end]
    out = np.full((v, n), -1, dtype=np.int64)
    e, c = layer.copy(), end.copy()
    live = np.isfinite(score)
    while live.any():
        r = rows[live]
        out[r, e[live]] = c[live]
        e[live], c[live] = came[e[live], r, c[live]], back[e[live], r, c[live]]
        live = live & (e >= 0)
    return out, np.where(np.isfinite(score), score, np.nan)


def align_time(pools: DataFrame, key: str, events: int, cost: float = 0.0, near: float = NEAR, far: float = FAR, span: float = math.inf, candidates: int = 20) -> DataFrame:
    """``key``, chain (a row id or null for each event), score of each row of ``pools``: key, c array<struct<i,row_id,pts,score>>.

    Of an event's candidates the ``candidates`` best are used, a row id once, with its best score; equal scores by
    smaller id. Candidates with a null, or with an event outside 0..``events``-1, take no part; a row without any has
    no chain and a null score.
    """
    return _aligned(pools, key, events, candidates, lambda *cube: align(*cube, cost, near, far, span))


def align_restart(pools: DataFrame, key: str, events: int, candidates: int = 20) -> DataFrame:
    """``align_time``'s columns for the best chain in rising time, which a candidate without a predecessor starts anew."""
    return _aligned(pools, key, events, candidates, restart)


def _aligned(pools: DataFrame, key: str, events: int, candidates: int, rule: Callable) -> DataFrame:
    kind = dict(pools.dtypes)[key]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(start, TOGETHER)
                shape = (batch.num_rows, events, candidates)
                ids, times, scores = np.zeros(shape, dtype=np.int64), np.zeros(shape), np.full(shape, np.nan)
                for v, c in enumerate(batch.column(1).to_pylist()):
                    layers: list[dict] = [{} for _ in range(events)]
                    for x in sorted((x for x in c or () if x and None not in x.values() and 0 <= x["i"] < events), key=lambda x: (-x["score"], x["row_id"], x["pts"])):
                        if len(layers[x["i"]]) < candidates:
                            layers[x["i"]].setdefault(x["row_id"], (x["pts"], x["score"]))
                    for e, chosen in enumerate(layers):
                        for j, (i, (t, s)) in enumerate(chosen.items()):
                            ids[v, e, j], times[v, e, j], scores[v, e, j] = i, t, s
                place, score = rule(ids, times, scores)
                picked = np.take_along_axis(ids, np.maximum(place, 0)[..., None], axis=2)[..., 0]
                chains = [[int(i) if p >= 0 else None for i, p in zip(a, b)] if (b >= 0).any() else [] for a, b in zip(picked, place)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chains, pa.list_(pa.int64())), pa.array(score, from_pandas=True)], names=[key, "chain", "score"])

    return pools.select(key, "c").mapInArrow(task, f"{key} {kind}, chain array<long>, score double")
