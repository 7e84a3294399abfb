"""Personal data: base patterns plus bootstrapped contextual extraction.

Base spans come from four fixed patterns (e-mail, IP address, card number, phone
number). They are the seeds of a pattern-instance graph over all documents. An instance
is the value of a seed or of a candidate: a token with at least four digits or an ``@``,
or up to four tokens that begin with ``+`` and hold the digits of a phone number. Values
are told apart by form, so an IP address and a number of the same digits are two. A
pattern is lexical (the word before or after, the two before, the second before with any
between, one before and one after), the shape of the value (its digits by count, its
letters as one, its signs), or the word before together with the shape. A dotted quad
with a part above 255 is no candidate, and a number of 14 to 19 digits that fails Luhn
has no shape: what the base patterns mean to leave out, a shape alone never brings back.

Spark scores both sides in turn: a pattern is worth the mean confidence of its
distinct instances and needs ``support`` trusted ones; an instance takes the
combined confidence of its high-confidence patterns. Candidates whose confidence
reaches ``accept``, and those whose value is a seed's, become spans of the kind. Base
spans always stay.

Rows of the graph are distinct (pattern, instance) pairs and their scores are sums, so
a very common context or value is aggregated before it is shuffled.

Defined results: a null text is the empty text, without spans. Repeated rows get the
same spans each. Offsets are code points, the end exclusive. A span that the graph adds
overlaps no other span; of two that would overlap the first stays, then the longer.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameseek.llm.common import Scratch, prepare, shielded

#: The kinds in order.
KINDS = ("email", "ip", "card", "phone")
# The base patterns. Possessive forms and the look-behind only keep long runs linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# From a token's first digit or @ to its end; the token's start is sought backwards, so a long run is read once.
_TOKEN = re.compile(r"[0-9@]\S*+")
_PHONE_PART = re.compile(r"[+(]?[0-9][0-9().-]*")
_QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_LONG_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_DIGITS, _LETTERS = re.compile(r"[0-9]+"), re.compile(r"[^\W\d_]+")
_EDGE = " .,;:!?()[]{}<>\"'|*#$%&=~`"
_WORD = re.compile(r"[^\W\d_]+")

SCHEMA = (
    "doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string,"
    " candidates array<struct<start:int,end:int,kind:int,inst:string,patterns:array<string>>>"
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def octets(quad: str) -> bool:
    """Whether every part is at most 255; parts may be of any length."""
    parts = [p.lstrip("0") for p in quad.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern: for each domain, the run of local characters before its @."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base spans, by start and then kind."""
    spans = [(s, e, 0) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if octets(m.group()):
                spans.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    spans.append((m.start(), m.end(), 3))
    return sorted(spans, key=lambda s: (s[0], s[2]))


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def shape(value: str) -> str:
    """Digits by their count, runs of letters as ``a``, signs as they are: ``+1 (555) 123`` is ``+d1 (d3) d3``."""
    return _DIGITS.sub(lambda m: f"\0{len(m.group())}", _LETTERS.sub("a", value[:80])).replace("\0", "d")


def instance(value: str) -> str:
    """The value's node: its form, and its characters without what the form lets vary."""
    digits = "".join(_DIGIT.findall(value))
    if "@" in value:
        return "mail:" + value.lower()
    if value.startswith("+"):
        return "plus:" + digits
    if _QUAD.fullmatch(value):
        return "quad:" + value
    return "number:" + digits if _LONG_NUMBER.fullmatch(value) else "other:" + value.lower()


def _patterns(text: str, start: int, end: int) -> list[str]:
    left = [w.lower() for w in _WORD.findall(text[max(0, start - 64) : start])][-2:]
    right = [w.lower() for w in _WORD.findall(text[end : end + 48])][:1]
    value, found = text[start:end], []
    number = _LONG_NUMBER.fullmatch(value)
    digits = "".join(_DIGIT.findall(value)) if number else ""
    if not (14 <= len(digits) <= 19) or luhn(digits):
        form = shape(value)
        found += [f"shape {form}"] + ([f"{left[-1]} | {form}"] if left else [])
    if left:
        found.append(f"{left[-1]} _")
    if right:
        found.append(f"_ {right[0]}")
    if len(left) == 2:
        found += [f"{left[0]} {left[1]} _", f"{left[0]} * _"]
    if left and right:
        found.append(f"{left[-1]} _ {right[0]}")
    return found


def _identifiers(text: str) -> Iterator[tuple[int, int]]:
    """Tokens with four digits or an inner @, and phone-like runs of up to four tokens from a plus sign."""
    for m in _TOKEN.finditer(text):
        s, e = m.span()
        while s and not text[s - 1].isspace():
            s -= 1
        plus = text.find("+", s, m.start())
        if plus >= 0 and not text[plus + 1 : m.start()].strip("("):
            at, digits = plus, 0
            for _ in range(4):
                part = _PHONE_PART.match(text, at)
                if not part:
                    break
                stop = part.end()
                while stop > at and not text[stop - 1].isdigit():
                    stop -= 1
                digits += len(_DIGIT.findall(part.group()))
                if 10 <= digits <= 15:
                    yield plus, stop
                if digits > 15 or text[part.end() : part.end() + 1] != " ":
                    break
                at = part.end() + 1
        while s < e and text[s] in _EDGE:
            s += 1
        while e > s and text[e - 1] in _EDGE:
            e -= 1
        core = text[s:e]
        if len(_DIGIT.findall(core)) < 4 and not (0 < core.find("@") < len(core) - 1):
            continue
        if not _QUAD.fullmatch(core) or octets(core):
            yield s, e


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds (the base spans) and further identifier-like tokens with their patterns."""
    out = [(s, e, k) for s, e, k in spans]
    merged: list[list[int]] = []
    for s, e, _ in spans:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    starts = [m[0] for m in merged]
    if "@" in text or _DIGIT.search(text):
        for s, e in _identifiers(text):
            nxt = bisect_right(starts, s)
            inside = nxt and merged[nxt - 1][1] > s
            if not inside and not (nxt < len(merged) and merged[nxt][0] < e):
                out.append((s, e, -1))
    return [{"start": s, "end": e, "kind": k, "inst": instance(text[s:e]), "patterns": _patterns(text, s, e)} for s, e, k in out]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("inst", pa.string()), ("patterns", pa.list_(pa.string()))])
    types = (pa.int64(), pa.int64(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.list_(kinds))
    for batch in batches:
        rows = []
        for doc, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            spans = base_spans(text) if text else []
            base = span_text(spans)
            n = [sum(1 for x in spans if x[2] == k) for k in range(4)]
            rows.append((doc, key, *n, hashlib.sha256(base.encode()).hexdigest(), base, candidates(text, spans) if text else []))
        if rows:
            names = ["doc_id", "text_hash", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "candidates"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)


def bootstrap(occurrences: DataFrame, scratch: Scratch, rounds: int = 3, support: int = 3, trust: float = 0.8, accept: float = 0.9) -> DataFrame:
    """(inst, kind, confidence) of the seeds and of the instances that high-confidence patterns discover."""
    seeds = occurrences.where("kind >= 0").groupBy("inst").agg(F.max("kind").alias("kind"), F.lit(1.0).alias("confidence"))
    seeds = scratch.save(seeds, "seeds")
    edges = occurrences.select(F.explode("patterns").alias("pattern"), "inst").distinct()
    marked = seeds.select(F.col("inst").alias("i"), "kind")
    graph = scratch.save(edges.join(marked, edges.inst == marked.i, "left").select("pattern", "inst", F.coalesce("kind", F.lit(-1)).alias("kind")), "graph")
    known = seeds
    for _ in range(rounds):
        sizes = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
        votes = graph.select("pattern", "inst").join(known, "inst").groupBy("pattern", "kind").agg(F.sum("confidence").alias("mass"), F.count(F.lit(1)).alias("trusted"))
        good = votes.where(F.col("trusted") >= support).join(sizes, "pattern").withColumn("worth", F.col("mass") / F.col("n")).where(F.col("worth") >= trust)
        scored = (
            graph.where("kind < 0")
            .select("pattern", "inst")
            .join(good.select("pattern", "kind", "worth"), "pattern")
            .groupBy("inst", "kind")
            .agg((1.0 - F.exp(F.sum(F.log(1.0 - F.least(F.col("worth"), F.lit(0.95)))))).alias("confidence"))
            .groupBy("inst")
            .agg(F.max(F.struct("confidence", "kind")).alias("best"))
            .select("inst", F.col("best.kind").alias("kind"), F.col("best.confidence").alias("confidence"))
            .where(F.col("confidence") >= accept)
        )
        found = scratch.save(scored, "found")
        known = seeds.unionByName(found)
    scratch.drop("graph")
    return known


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, text_hash, base counts, base_sha256, base and all spans, and how many the contexts added."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(_scan, SCHEMA)
    scratch = Scratch(docs.sparkSession, "pii")
    rows = scratch.save(rows, "rows")
    occurrences = rows.select("doc_id", "text_hash", F.inline("candidates"))
    found = bootstrap(occurrences, scratch)
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(i), F.lit(k))])
    added = (
        occurrences.where("kind < 0")
        .select("doc_id", "text_hash", "start", "end", "inst")
        .join(found.select("inst", "kind"), "inst")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("start", (-F.col("end")).alias("until"), "kind")).alias("extra"))
    )
    # By start, then the longest: what overlaps the span kept last goes.
    span = "array<struct<start:int,kind:int,end:int>>"
    keep = lambda kept, x: F.when((F.size(kept) > 0) & (F.element_at(kept, -1)["end"] > x["start"]), kept).otherwise(F.concat(kept, F.array(F.struct(x["start"].alias("start"), x["kind"].alias("kind"), (-x["until"]).alias("end")))))
    added = added.select("doc_id", "text_hash", F.aggregate(F.array_sort("extra"), F.array().cast(span), keep).alias("extra"))
    left = rows.drop("candidates").alias("r")
    hit = added.alias("a")
    same = F.col("r.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("r.text_hash") == F.col("a.text_hash"))
    kind_no = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    parse = lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("start"), kind_no[F.split(s, ":")[0]].alias("kind"), F.split(s, ":")[2].cast("int").alias("end"))
    base = F.when(F.col("r.base") == "", F.array().cast(span)).otherwise(F.transform(F.split("r.base", ","), parse))
    every = F.array_sort(F.concat(base, F.col("a.extra")))
    spans = F.array_join(F.transform(every, lambda x: F.concat_ws(":", order[x["kind"]], x["start"], x["end"])), ",")
    return left.join(hit, same, "left").select("r.*", F.when(F.col("a.extra").isNull(), F.col("r.base")).otherwise(spans).alias("spans"), F.coalesce(F.size("a.extra"), F.lit(0)).cast("long").alias("n_added"))


def _masked(text: str, spans: str) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one."""
    parts, last = [], 0
    for span in spans.split(","):
        kind, start, end = span.split(":")
        start, end = int(start), int(end)
        if start >= last:
            parts += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, end)
    return "".join([*parts, text[last:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span masked; rows, columns and other texts stay as they are."""
    docs, (id_col, text_col), old = shielded(docs, id_col, text_col)
    spans = find(docs, id_col, text_col).where("spans <> ''").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans")).dropDuplicates(["_id", "_hash"])
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text_col)) == F.col("_hash"))
    rows = docs.join(spans, same, "left")
    names, at = docs.columns, docs.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
            new = pa.array([_masked(t, m) if m else t for t, m in zip(texts, marks)], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else batch.column(i) for i in range(len(names))], names=names)

    return rows.select(*names, "_spans").mapInArrow(apply, docs.schema).toDF(*old)
