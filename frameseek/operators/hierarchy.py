"""Labels found in texts by phrases, and what stands above them in a hierarchy.

The runs of up to four words of the texts meet the phrases in one join, so of a large dictionary no
more than its phrases is shuffled. A match strictly inside a longer one goes, which a running maximum
of ends decides without pairs; partial overlaps stay.

The closure of a hierarchy is semi-naive: a round joins only the pairs that the last one found,
and each writes what it finds to the checkpoint folder, so a cycle ends when nothing new comes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameseek.functions import text as tx
from frameseek.operators.staging import dropped, staged, written


#: Rounds of a closure after which their pairs become one table: a plan names no more of them.
ROUNDS = 16


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, node): every node that is reached from a seed over (child, parent) edges, the seed itself first.

    ``seeds`` has one column, seed. Null seeds and edges with a null end take no part; repeated rows count once.
    """
    edges = written(edges.select(F.col(edges.columns[0]).alias("child"), F.col(edges.columns[1]).alias("parent")).where("child is not null and parent is not null").distinct())
    fresh = known = written(seeds.toDF("seed").where("seed is not null").distinct().select("seed", F.col("seed").alias("node")))
    parts = [known]
    while not fresh.isEmpty():
        above = fresh.join(edges, F.col("node") == F.col("child")).select("seed", F.col("parent").alias("node")).distinct()
        fresh = written(above.join(known, ["seed", "node"], "left_anti"))
        # Pairs are written once, by the round that finds them.
        known = known.union(fresh)
        parts.append(fresh)
        if len(parts) > ROUNDS:
            known, fresh = written(known), written(fresh)
            dropped(*parts)
            parts = [known]
    dropped(edges)
    return known


def tokens(c: Column) -> Column:
    """Words of letters, digits and underscores; a position a word."""
    return F.regexp_extract_all(c, F.lit(tx.WORD), F.lit(0))


def matches(texts: DataFrame, phrases: DataFrame, most: int = 4) -> DataFrame:
    """(qid, a, z, phrase): each phrase of up to ``most`` words at its first and last position; ``texts``: qid, words; ``phrases``: phrase.

    A phrase's words are joined by one space. A phrase of more words matches nothing.
    """
    known = phrases.select("phrase").where("phrase is not null").where(F.size(F.split("phrase", " ")).between(1, most)).distinct()
    ahead = F.transform("words", lambda x, i: F.slice("words", i + 1, F.least(F.lit(most), F.size("words") - i)))
    spots = texts.select("qid", F.posexplode(ahead).alias("a", "ahead"))
    begun = F.transform("ahead", lambda x, i: F.struct(i.alias("i"), F.array_join(F.slice("ahead", F.lit(1), i + 1), " ").alias("phrase")))
    runs = spots.select("qid", "a", F.explode(begun).alias("x")).select("qid", "a", (F.col("a") + F.col("x.i")).alias("z"), "x.phrase")
    return runs.join(known, "phrase").select("qid", "a", "z", "phrase")


def maximal(found: DataFrame) -> DataFrame:
    """``matches`` without those strictly inside a longer one; equal spans and partial overlaps stay."""
    own = F.max("z").over(Window.partitionBy("qid", "a"))
    before = F.max("z").over(Window.partitionBy("qid").orderBy("a").rangeBetween(Window.unboundedPreceding, -1))
    return found.select("*", own.alias("own"), before.alias("before")).where((F.col("own") == F.col("z")) & (F.col("before").isNull() | (F.col("before") < F.col("z")))).drop("own", "before")


def labels_of(texts: DataFrame, dictionary: DataFrame, parents: bool = True, most: int = 4) -> DataFrame:
    """(qid, label) named by the texts (qid, text) and, with ``parents``, all labels above them.

    ``dictionary``: label, phrase, parent; a phrase can name several labels. A text with accents is matched as it
    is, lower-cased; one without is matched with the folded phrases. Null texts and phrases name nothing.
    """
    plain = tx.fold_full(F.col("text")) == F.trim(F.lower("text"))
    asked = texts.where("text is not null").select("qid", plain.alias("plain"), F.when(plain, tx.fold_full(F.col("text"))).otherwise(F.lower("text")).alias("t"))
    asked = staged(asked.select("qid", "plain", tokens(F.col("t")).alias("words")))
    phrase = F.array_join(F.filter(F.split(F.lower(F.trim("phrase")), r"\s+"), lambda w: w != ""), " ")
    named = written(dictionary.where("phrase is not null and label is not null").select("label", phrase.alias("phrase")).distinct())
    out = None
    for folded in (False, True):
        d = named.select("label", tx.fold_full(F.col("phrase")).alias("phrase") if folded else F.col("phrase")).distinct()
        found = maximal(matches(asked.where("plain" if folded else "not plain"), d, most))
        some = found.join(d, "phrase").select("qid", "label").distinct()
        out = some if out is None else out.union(some)
    if not parents:
        return out
    out = staged(out)
    dropped(named)
    above = closure(out.select("label"), dictionary.select("label", "parent"))
    return out.join(above, F.col("label") == F.col("seed")).select("qid", F.col("node").alias("label")).distinct()
