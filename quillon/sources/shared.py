"""The folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where the session names none, a temporary folder, in local mode only."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: made once, whatever is asked of them, and lost with no executor."""
    at, schema = scratch_path(df.sparkSession, name), df.schema
    df.write.parquet(at)
    return df.sparkSession.read.schema(schema).parquet(at)


def sized(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A written table of short rows, to be broadcast if it is counted to hold few; else Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= rows else df
