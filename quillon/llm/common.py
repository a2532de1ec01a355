"""What the operators of this subpackage share: input shape, shared scratch tables, word splitting."""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.shared import drop_path, scratch_path, shared_dir

WORD = re.compile(r"\w+")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id BIGINT, text STRING): extra columns, whatever their names, go no further.

    Rows without an id can't be reported on and are left out; a null text counts as empty.
    """
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).where(F.col("doc_id").isNotNull())


class Written:
    """A table written to the shared folder: its lineage is cut, and losing executors loses nothing."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, name)
        schema = df.schema
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def sized(ids: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """A written table of ids, to be broadcast if it is counted to hold few rows; else Spark shuffles both sides."""
    return F.broadcast(ids) if ids.count() <= rows else ids


def clear_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this library in the shared folder."""
    drop_path(spark, f"{shared_dir(spark)}/quillon")


class WordHash(dict):
    """word -> 64-bit hash, remembered; emptied when it grows too large for a worker."""

    LIMIT = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def connected(edges: DataFrame, name: str = "components") -> Written:
    """Connected components of edges (a, b): a written table (node, label), label the smallest node.

    Every round takes the least label among neighbours and then jumps to the label's own label, so
    that the rounds grow with the logarithm of the longest chain. The labels are a written table
    after each round.
    """
    both = Written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), name + "-edges")
    now = Written(both.df.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), name)
    while True:
        near = both.df.join(now.df, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        least = now.df.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = now.df.select(F.col("node").alias("at"), F.col("label").alias("on"))
        after = Written(least.join(jump, F.col("label") == F.col("at")).select("node", "was", F.least("label", "on").alias("label")), name)
        now.drop()
        moved = after.df.where("was <> label").limit(1).count()
        now = after
        if not moved:
            both.drop()
            now.df = now.df.select("node", "label")
            return now
