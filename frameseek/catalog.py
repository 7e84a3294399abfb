"""All queries of the retrieval engine's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameseek.plans import assembly, channels, etl, evaluation, fusion, phrases, relational, text, timeline
from frameseek.plans.registry import ORACLES, QUERIES, Tables

PLANS = (channels, text, phrases, fusion, timeline, evaluation, relational, assembly, etl)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and text rankings of the same queries, fused by reciprocal rank and capped per group."""
    return channels.flagship(Tables(spark, sf_dir))
