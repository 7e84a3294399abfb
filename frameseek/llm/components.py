"""Connected components of a link table, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameseek.llm.common import Scratch

#: A hub's rows go to so many tasks: its side of a join carries a salt, the other side a row for each salt.
SALTS = 8


def _salted(col: str) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(SALTS))


def _every_salt() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))


def connected_components(links: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, comp) of every linked node, comp the least node of its component.

    Least labels pass along links and then along labels (pointer jumping), so the rounds
    grow with the logarithm of a component's width. Each round is one durable table, and
    the table of the round before is dropped. A hub's links and the members of a large
    component are salted over SALTS tasks; minima are taken before a shuffle.

    Defined results: a link with a null end, or of a node with itself, links nothing;
    repeated links and links given both ways count once; an empty table has no nodes.
    """
    scratch = scratch or Scratch(links.sparkSession, "components")
    down = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    # A node's lower neighbours hang on the least of them: as connected, with one link a node.
    lowest = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "at")
    hung = down.join(lowest, down.u == lowest.at).select("v", "m").where("v <> m")
    down = lowest.select("at", "m").union(hung).distinct()
    both = down.toDF("u", "v").union(down.select("m", "at"))
    both = scratch.save(both.withColumn("salt", _salted("u")), "cc-links")
    labels = scratch.save(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"), "cc-labels")
    while True:
        known = labels.select(F.col("node").alias("at"), "label", _every_salt().alias("s"))
        near = both.join(known, (both.v == known.at) & (both.salt == known.s)).groupBy("u").agg(F.min("label").alias("least"))
        step = labels.join(near, labels.node == near.u).select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        step = step.withColumn("salt", _salted("node"))
        # A node that is a label jumps on to its own label; the others have nowhere further to go.
        to = step.where("label <> node").select(F.col("node").alias("at"), F.col("label").alias("jump"), _every_salt().alias("s"))
        step = step.join(to, (step.label == to.at) & (step.salt == to.s), "left").select("node", "old", F.coalesce("jump", "label").alias("label"))
        step = scratch.save(step, "cc-labels")
        labels = step.select("node", "label")
        if not step.where("old <> label").limit(1).count():
            return labels.withColumnRenamed("label", "comp")
