"""Streaming catalogue load: new item files are appended, readers take the latest row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytable.operators.skew import first_by
from skytable.sources.files import ITEM_SCHEMA

KEYS = ("collection", "id")


def run_items(spark: SparkSession, source: str, out: str, checkpoint: str) -> None:
    """Load what is available. A batch that is run again replaces its own folder, so no row doubles."""
    items = spark.readStream.schema(ITEM_SCHEMA).json(source).select("*", F.col("_metadata.file_modification_time").alias("loaded_at"))

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    (
        items.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(append)
        .start()
        .awaitTermination()
    )


def current_items(spark: SparkSession, out: str) -> DataFrame:
    """The latest item per collection and id."""
    batches = spark.read.option("basePath", out).parquet(out).drop("batch")
    # Maps cannot be compared, but they may ride along with the winning row.
    return first_by(batches, list(KEYS), [-F.col("batch_id"), -F.unix_micros("loaded_at")]).drop("batch_id", "loaded_at")
