"""Tables that several readers share: written once to the checkpoint folder, so losing an executor loses none of them.

With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes a table once nothing refers to it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir; without one a temporary folder, on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="frameseek-")


def staged(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like ``staged``, as compressed columns: for tables that grow with the input. A checkpoint holds rows as they lie in memory."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(df.sparkSession))
    path = f"{context.getCheckpointDir().rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Takes away what ``written`` wrote, once all readers have run."""
    for df in tables:
        spark = df.sparkSession
        for place in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
