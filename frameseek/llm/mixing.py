"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Each source's documents, shuffled by hash, lie end to end and are cut into blocks of
BLOCK words (the last one shorter). A source's target in words gives it a whole number
of slots; all sources' slots together are the schedule, N long. Slot i takes the golden
ratio point (i * g mod N) with g next to N divided by the golden ratio and without a
common divisor, so the N points are a permutation: mapped through the sources'
cumulative slot counts, every stretch of the schedule mixes the sources by weight and
each source gets exactly its slots. Ranked within its source, slot r takes block r (after
the last block the first again, for at most two rounds), and the last slot takes only
the words that are missing to the target. The schedule is the order of the mix: a
document stands at the first slot that takes words of it, and `materialise` lays the
texts out in that order.

Ranks and running sums over a source go through fixed-size buckets (local order, then
a running sum of bucket totals), so a hot source is no single task.

Defined results: a null text has size 0. The null source is a source, the last. Sources
without words have target 0. Rows equal in id and text are interchangeable. Everything
follows from ids and texts, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameseek.llm.common import shielded, staged

BLOCK = 64
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
#: Slots in one bucket of the schedule.
STRETCH = 65_536


def running(df: DataFrame, group: list[str], bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before, within ``group`` and by (bucket, order)."""
    local = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    rows = df.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0)))
    keys = [*group, bucket]
    sums = sums.toDF(*[f"_{c}" for c in keys], "_before")
    match = F.lit(True)
    for c in keys:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(sums.hint("merge"), match).select(*df.columns, (F.col("_local") + F.col("_before")).alias(name))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target): weights share the total, stopped at MOST times a source's size.

    The reshare of what is cut off ends where min(cap, level * weight) sums to the total;
    with sources by cap over weight, the level is that of the first source below its cap.
    """
    order = Window.partitionBy("one").orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = sizes.withColumn("one", F.lit(1)).withColumn("weight", cycle).withColumn("cap", MOST * F.col("source_size"))
    every = Window.partitionBy("one")
    by_cap = Window.partitionBy("one").orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", SHARE * F.sum("source_size").over(every))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0)))
    s = s.withColumn("weights", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.col("weights"))
    # The level grows along the order until it no longer exceeds the ratio: the greatest is the answer.
    s = s.withColumn("answer", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every))
    return s.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("answer") * F.col("weight")), F.col("cap")).alias("target"))


def _step(n: int) -> int:
    """The whole number next to n / golden ratio that has no common divisor with n."""
    start = max(1, round(n * 2 / (1 + math.sqrt(5))))
    for d in range(n + 1):
        for g in (start + d, start - d):
            if 0 < g and math.gcd(g, n) == 1:
                return g
    return 1


def schedule(sources: DataFrame, total: int) -> DataFrame:
    """(source_no, slot, rank): the sources' slots in order. ``sources``: source_no, slots.

    A source owns the points [lo, hi) of the line; as the points are a permutation, its
    slots are those points taken back through the inverse step, so no join looks them up.
    """
    back = pow(_step(total), -1, total) if total > 1 else 0
    line = Window.partitionBy(F.lit(1)).orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    stretch = sources.where("slots > 0").withColumn("lo", F.coalesce(F.sum("slots").over(line), F.lit(0)))
    stretch = stretch.withColumn("hi", F.col("lo") + F.col("slots"))
    # A source's points go out in runs of STRETCH, dealt over tasks: a hot source is many runs.
    runs = stretch.select("source_no", "hi", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, F.lit(STRETCH).cast("long"))).alias("from"))
    runs = runs.repartition(max(8, min(100_000, -(-total // (8 * STRETCH)))), "from")
    points = runs.select("source_no", F.explode(F.sequence("from", F.least(F.col("from") + STRETCH, "hi") - 1)).alias("point"))
    if total < 1 << 31:
        slot = (F.col("point") * F.lit(back)) % F.lit(total)
    else:  # the product needs more than 63 bits
        slot = ((F.col("point").cast("decimal(19,0)") * F.lit(back).cast("decimal(19,0)")) % F.lit(total).cast("decimal(19,0)")).cast("long")
    dealt = points.select("source_no", slot.cast("long").alias("slot"))
    dealt = dealt.withColumn("bucket", F.floor(F.col("slot") / STRETCH))
    return running(dealt, ["source_no"], "bucket", ["slot"], F.lit(1), "rank").select("source_no", "slot", "rank")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, and of each round the words taken and the first slot.

    ``slots`` is the schedule's length; ``first_slot``, ``slot_1`` and ``slot_2`` are null where nothing is taken.
    """
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col(source_col).alias("source"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))).alias("h"),
    )
    d = staged(d, "mix-sizes")
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    names = Window.partitionBy(F.lit(1)).orderBy(F.col("source").isNull(), "source")
    plan = targets(sizes).withColumn("source_no", F.row_number().over(names))
    plan = plan.withColumn("want", F.round("target").cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / BLOCK))
    more = F.greatest(F.col("want") - F.col("source_size"), F.lit(0))
    plan = plan.withColumn("slots", F.ceil(F.least("want", "source_size") / BLOCK) + F.ceil(more / BLOCK))
    plan = staged(plan, "mix-plan")
    rows, total = d.count(), int(plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0])

    digits = max(1, math.ceil(math.log(max(rows, 1) / 2000 + 1, 16)))
    placed = d.withColumn("bucket", F.substring("h", 1, digits))
    placed = running(placed, ["source"], "bucket", ["h", "doc_id"], F.col("size"), "start")
    placed = placed.join(plan.select(F.col("source").alias("_s"), "source_no", "source_size", "target"), placed.source.eqNullSafe(F.col("_s")))
    placed = staged(placed.select("source_no", "h", "doc_id", "start", "size", "source_size", "target"), "mix-placed")
    if not total:
        zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
        return placed.select("doc_id", "size", "source_size", "target", *[zero.alias(c) for c in ("taken", "taken_1", "taken_2")], *[none.alias(c) for c in ("first_slot", "slot_1", "slot_2")], zero.alias("slots"), "h")

    # Equal-token blocks: the pieces of documents that each holds.
    pieces = placed.where("size > 0").select("source_no", "h", "doc_id", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK))).alias("block"))
    pieces = pieces.withColumn("lo", F.greatest("start", F.col("block") * BLOCK)).withColumn("hi", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK))
    # What each slot takes: its block's words up to the end, or to where the target is met.
    slots = schedule(plan.select("source_no", "slots"), total).join(plan.select("source_no", "blocks", "want", "source_size"), "source_no")
    slots = slots.withColumn("pass", F.floor(F.col("rank") / F.col("blocks"))).withColumn("block", F.pmod("rank", "blocks"))
    slots = slots.withColumn("until", F.least((F.col("block") + 1) * BLOCK, F.col("source_size"), F.col("want") - F.col("pass") * F.col("source_size")))
    in_pass = lambda n, c: F.when(F.col("pass") == n, F.col(c))
    slots = slots.groupBy("source_no", "block").agg(*[x for n in (0, 1) for x in (F.max(in_pass(n, "until")).alias(f"until_{n + 1}"), F.min(in_pass(n, "slot")).alias(f"at_{n + 1}"))])
    took = pieces.join(slots.hint("merge"), ["source_no", "block"])
    part = lambda n: F.greatest(F.least(F.col("hi"), F.coalesce(F.col(f"until_{n}"), F.lit(0))) - F.col("lo"), F.lit(0))
    # Rows equal in id and text differ in start.
    took = took.groupBy(F.col("source_no").alias("_no"), F.col("h").alias("_h"), F.col("start").alias("_start"))
    took = took.agg(*[x for n in (1, 2) for x in (F.sum(part(n)).alias(f"t{n}"), F.min(F.when(part(n) > 0, F.col(f"at_{n}"))).alias(f"slot_{n}"))])
    found = placed.join(took.hint("merge"), (F.col("source_no") == F.col("_no")) & (F.col("h") == F.col("_h")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0), "left")
    t1, t2 = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("t1", "t2"))
    return found.select("doc_id", "size", "source_size", "target", (t1 + t2).alias("taken"), t1.alias("taken_1"), t2.alias("taken_2"), F.least("slot_1", "slot_2").alias("first_slot"), "slot_1", "slot_2", F.lit(total).cast("long").alias("slots"), "h")


def materialise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself in the schedule's order: a row for each document and round in which words of it are taken.

    A document cut by its source's target keeps its first words; a document taken twice
    comes twice, at the slots of its rounds; one of which nothing is taken goes. Output
    partition p holds the p-th stretch of the schedule, sorted by slot, so every stretch of
    the corpus mixes the sources by weight.
    """
    n_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    docs, (id_col, text_col, source_col), names = shielded(docs, id_col, text_col, source_col)
    rounds = F.array(*[F.struct(F.col(f"taken_{n}").alias("take"), F.col(f"slot_{n}").alias("slot")) for n in (1, 2)])
    taken = mix(docs, id_col, text_col, source_col).select(F.col("h").alias("_h"), "slots", F.explode(rounds).alias("_take")).where("_take.take > 0")
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    # Rows equal in id and text: number both sides, so that each row meets its own takes.
    own = Window.partitionBy("_k").orderBy("_k")
    taken = taken.groupBy("_h").agg(F.sort_array(F.collect_list("_take"), asc=False).alias("_takes"), F.max("slots").alias("_slots"))
    texts = docs.withColumn("_k", key).withColumn("_n", F.row_number().over(own)).withColumn("_of", F.count(F.lit(1)).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = texts.join(taken.hint("merge"), F.col("_k") == F.col("_h")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_takes") - 1))).where(F.pmod(F.col("_i"), F.col("_of")) == F.col("_n") - 1)
    rows = rows.withColumn("_take", F.get("_takes", F.col("_i"))["take"]).withColumn("_slot", F.get("_takes", F.col("_i"))["slot"])
    size = F.regexp_count(F.col(text_col), F.lit(WORD))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)), F.lit(1), F.col("_take").cast("int")), "")
    text = F.when(F.col("_take") >= size, F.col(text_col)).otherwise(first)
    out = {text_col: text, f"c{n_at}": F.length(text).cast("long")}
    rows = rows.select(*[(out[c].alias(c) if c in out else F.col(c)) for c in docs.columns], "_slot", "_k", "_slots")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The stretch of a slot is known without sampling: slots are even over the schedule.
    rows = rows.repartitionById(parts, F.floor(F.col("_slot") * parts / F.col("_slots")).cast("int")).sortWithinPartitions("_slot", "_k")
    return rows.select(*docs.columns).toDF(*names)
