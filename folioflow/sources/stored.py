"""Written intermediates in a folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; that is set here only in local mode (tests, a single machine)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/folioflow-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` and read it back: what follows neither computes it again nor loses it with an executor."""
    spark, path = df.sparkSession, path or shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def appended(df: DataFrame, path: str, *partitions: str) -> None:
    """Append rows to a table in one commit: a write that fails leaves nothing that readers see."""
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder was committed at least once."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that ``appended`` writes; without rows before the first commit."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.range(0).select(F.from_json(F.lit(""), schema).alias("r")).select("r.*")
