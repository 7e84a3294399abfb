"""What the training-data operators share: the work folder, staged tables, splits.

Every intermediate table goes to the folder that the cluster names in
``spark.checkpoint.dir`` (all executors see it), so a lost executor costs a task
and never a result.
"""

from __future__ import annotations

import gc
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python; bounds a worker's memory when texts are long.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on; returns the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a temporary one only on a local master where none is configured."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="frameseek-")
        sc.setCheckpointDir(named)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage at a durable table."""
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """An operator's intermediate tables under one folder, dropped by name once their last reader has run."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.folder = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._made = 0
        self._at: dict[str, str] = {}
        self._known: dict[str, str] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back under ``name``; a table saved before under that name goes."""
        self._made += 1
        path = f"{self.folder}/{name}-{self._made}"
        df.write.option("compression", "zstd").parquet(path)
        self.drop(name)
        self._at[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def save_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """``save`` as a table bucketed by ``key``: later joins on it take its rows where they lie, without a shuffle."""
        self._made += 1
        path, known = f"{self.folder}/{name}-{self._made}", f"scratch_{uuid.uuid4().hex}"
        dealt = df.repartition(buckets, key).write.option("compression", "zstd").option("path", path)
        dealt.bucketBy(buckets, key).format("parquet").saveAsTable(known)
        self._at[name], self._known[name] = path, known
        return self.spark.table(known)

    def drop(self, *names: str) -> None:
        """Delete tables whose readers have all run, and what the catalogue knows of them."""
        for name in names:
            if name in self._known:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._known.pop(name)}")
            if name in self._at:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self._at.pop(name))
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let go of the shuffle files of jobs that nothing refers to any more (Spark's cleaner acts on collected plans)."""
        gc.collect()
        self.spark._jvm.System.gc()


def crc_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def sample_cut(rows: DataFrame, group: str, hashed: str, wanted: int) -> Column:
    """Rows whose hash lies below their group's cut: about 1.25 * ``wanted`` of each group, all of a small one.

    One count a group reaches the driver; no rows are ranked or shuffled.
    """
    cut = F.lit(False)
    for value, n in rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect():
        most = 2**63 - 1 if n <= 1.25 * wanted else int(-(2**63) + 1.25 * wanted / n * 2**64)
        cut = cut | ((F.col(group) == F.lit(value)) & (F.col(hashed) <= F.lit(most)))
    return cut


def total_chars(df: DataFrame, text_col: str) -> int:
    """Code points in the column, one column-pruned scan."""
    return int(df.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0])


def parts_for(chars: int, per_part: int = 16_000_000, least: int = 64) -> int:
    """How many hash parts keep one part's share bounded as the corpus grows."""
    return max(least, math.ceil(chars / per_part))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shielded(docs: DataFrame, *cols: str) -> tuple[DataFrame, list[str], list[str]]:
    """``docs`` under positional names (none can clash with a helper column), those of ``cols``, the old names."""
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return safe, [f"c{names.index(c)}" for c in cols], names
