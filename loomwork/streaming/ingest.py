"""Incremental ingestion of files (an extension: the service's own stream is a loop over pages)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def new_rows(spark: SparkSession, folder: str, schema: str, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Rows of Parquet files as they arrive, each key once within the watermark."""
    return spark.readStream.schema(schema).parquet(folder).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def ingest(rows: DataFrame, target: str, checkpoint: str) -> None:
    """Appends all rows that are there to a table, exactly once, and stops."""
    query = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
