"""Operators whose next step depends on the last: greedy suppression, beams, chains, packing.

Each is plain Python over one bounded group (the candidates of one query and video) and
runs as a grouped map; nothing larger than a group's candidate pool meets in a task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence


def step_penalty(gap: float, near: float = 1.0, close: float = 1.0, far: float = 60.0, beta: float = 0.0005) -> float:
    """Cost of a step: ``close`` below ``near``, nothing up to ``far``, then ``beta`` for each second beyond it."""
    if gap < near:
        return close
    return beta * max(gap - far, 0.0)


def beam(events: Sequence[Sequence[tuple[int, float, float]]], width: int = 64, spacing: float = 3.0, want: int = 5, penalty: Callable[[float], float] | None = None) -> list[tuple[list[int], float]]:
    """Best chains of one (id, time, score) per event with rising time.

    An event that no chain can reach leaves no chain. A chain is kept when any position
    is more than ``spacing`` away from every kept chain.
    """
    if not events or not all(events):
        return []
    chains = [([c], c[2]) for c in events[0]]
    for options in events[1:]:
        chains = sorted(chains, key=lambda x: (-x[1], [c[0] for c in x[0]]))[:width]
        chains = [(path + [c], s + c[2] - (penalty(c[1] - path[-1][1]) if penalty else 0.0)) for path, s in chains for c in options if c[1] > path[-1][1]]
        if not chains:
            return []
    out: list[tuple[list[tuple], float]] = []
    for path, s in sorted(chains, key=lambda x: (-x[1], [c[0] for c in x[0]]))[:width]:
        if all(any(abs(a[1] - b[1]) > spacing for a, b in zip(path, old)) for old, _ in out):
            out.append((path, s))
        if len(out) == want:
            break
    return [([c[0] for c in path], s) for path, s in out]


def split_clauses(text: str, most: int = 40) -> list[str]:
    """Whole if short; else sentences packed greedily up to ``most`` words, longer ones cut hard."""
    if len(text.split()) <= most:
        return [text.strip()]
    out: list[list[str]] = []
    for sentence in re.split(r"(?<=[.!?;])\s+", text.strip()):
        words = sentence.split()
        if out and len(out[-1]) + len(words) <= most:
            out[-1] += words
            continue
        out += [words[i : i + most] for i in range(0, len(words), most)]
    return [" ".join(w) for w in out]


_EVENT = re.compile(r"^\s*(?:E\s*\d+|(?:event|scene|step)\s*\d+)\s*[:.)-]?\s*", re.I)


def split_events(text: str) -> list[str]:
    """Marked lines, each behind the leading context; else lines, ';' parts or numbered parts."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    marked = [i for i, x in enumerate(lines) if _EVENT.match(x)]
    if len(marked) >= 2:
        head = " ".join(lines[: marked[0]])
        return [f"{head} {_EVENT.sub('', lines[i])}".strip() for i in marked]
    for parts in (lines, text.split(";"), re.split(r"\s*\(?\d+[.)]\s+", text)):
        parts = [p.strip() for p in parts if p.strip()]
        if len(parts) >= 2:
            return parts
    return [text.strip()]


def quota_union(lists: Sequence[Sequence[int]], quotas: Sequence[int], total: int) -> list[int]:
    """Each channel's quota of unseen ids in turn, then the rest of the channels to fill up."""
    out: list[int] = []
    seen: set[int] = set()
    for some, q in [*zip(lists, quotas), *((x, total) for x in lists)]:
        for i in some:
            if q <= 0 or len(out) >= total:
                break
            if i not in seen:
                seen.add(i)
                out.append(i)
                q -= 1
    return out
