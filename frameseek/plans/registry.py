"""Registered queries: a name, a plan over the driver's tables, and its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables by attribute: ``t.events``; ``t.frames`` is events under the retrieval names."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        """A scan of fewer parts than the session has cores is dealt out by id, so text work uses them all; a wide scan stays as it is."""
        docs, cores = self.spark.read.parquet(f"{self.sf_dir}/documents.parquet"), self.spark.sparkContext.defaultParallelism
        return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores, "doc_id")

    @property
    def frames(self) -> DataFrame:
        """row_id, video_id, us (microseconds), label, score."""
        us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
        return self.events.select(F.col("event_id").alias("row_id"), F.col("user_id").alias("video_id"), us.alias("us"), F.col("event_type").alias("label"), F.col("value").alias("score"))


#: The same view for the oracles; queries start with WITH and this.
FRAMES = "e AS (SELECT event_id AS row_id, user_id AS video_id, epoch_us(ts) AS us, event_type AS label, value AS score FROM events)"


def query(name: str, sql: str | None = None):
    def register(plan: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return plan

    return register


def shared(name: str, sql: str, views: str) -> None:
    """A relational idiom whose Spark plan is SQL too: ``views`` names the tables it reads."""

    def plan(t: Tables) -> DataFrame:
        for v in views.split():
            (t.frames if v == "e" else getattr(t, v)).createOrReplaceTempView(v)
        return t.spark.sql(sql)

    QUERIES[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
    if sql.lstrip().upper().startswith("WITH RECURSIVE"):
        ORACLES[name] = sql
        return
    ORACLES[name] = f"WITH {FRAMES} {sql}" if not sql.lstrip().upper().startswith("WITH") else f"WITH {FRAMES}, {sql.lstrip()[5:]}"
