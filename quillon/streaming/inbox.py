"""An inbox of manifest rows as a stream: each file is validated as it arrives, good and bad rows part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators import validate
from quillon.sources import manifest as manifests


def arriving(spark: SparkSession, inbox: str, files_at_once: int = 100) -> DataFrame:
    """The rows of tab-separated files put into the inbox, validated, with the time they were read; rows of another width have an error."""
    schema = ", ".join(f"{c} string" for c in validate.COLUMNS) + ", _corrupt string"
    rows = spark.readStream.option("maxFilesPerTrigger", files_at_once).csv(inbox, schema=schema, sep="\t", header=True, quote='"', escape='"', multiLine=True, enforceSchema=False, columnNameOfCorruptRecord="_corrupt")
    return manifests.width_checked(validate.validated(rows)).withColumn("seen", F.current_timestamp())


def start(spark: SparkSession, inbox: str, accepted: str, quarantined: str, checkpoint: str, within: str = "1 day") -> StreamingQuery:
    """Write good rows to one Parquet folder and the others to another, once each.

    A row that comes again within the watermark, by id and hash, is dropped. The batch's number is
    the name of its part, so that a batch that is run again replaces what it wrote.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where(F.size("errors") == 0).drop("errors").write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        batch.where(F.size("errors") > 0).write.mode("overwrite").parquet(f"{quarantined}/batch={number}")
        batch.unpersist()

    once = arriving(spark, inbox).withWatermark("seen", within).dropDuplicatesWithinWatermark(["item_id", "sha256"])
    return once.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
