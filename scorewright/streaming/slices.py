"""An extension: recomputed slices that arrive as files are merged as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, value double, perfect boolean"


def merge(current: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Entries by key with the newest file's winning; applying a file again changes nothing."""
    rows = batch if current is None else current.unionByName(batch)
    best = F.max_by(F.struct("value", "perfect", "arrived", "file"), F.struct("arrived", "file"))
    return rows.groupBy("key").agg(best.alias("x")).select("key", "x.*")


def follow(spark: SparkSession, folder: str, target: str, checkpoint: str):
    """Merge all slice files (JSON lines) of ``folder`` into ``target``; returns when none is left.

    A batch writes its own entries only, to a folder of its number, so a batch that is run again
    changes nothing. ``state`` merges them when read, ``compact`` for good.
    """
    files = spark.readStream.schema(SCHEMA).json(folder)
    files = files.select("key", "value", "perfect", F.col("_metadata.file_modification_time").alias("arrived"), F.col("_metadata.file_name").alias("file"))

    def apply(batch: DataFrame, version: int) -> None:
        merge(None, batch).write.mode("overwrite").parquet(f"{target}/batch={version}")

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, target: str) -> DataFrame:
    """The newest entry of each key."""
    return merge(None, spark.read.option("basePath", target).parquet(target).drop("batch"))


def compact(spark: SparkSession, target: str, compacted: str) -> DataFrame:
    """Write the state as one batch of another target, which later batches can follow."""
    state(spark, target).write.mode("overwrite").parquet(f"{compacted}/batch=-1")
    return state(spark, compacted)
