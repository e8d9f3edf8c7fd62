"""Work that arrives as files: windowed counts and once-only processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, schema, most_files: int = 1000) -> DataFrame:
    """Parquet files as they arrive; the checkpoint of the sink remembers those done."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def windowed_counts(events: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per event-time window; rows later than the watermark are dropped by contract."""
    t = F.col(time).cast("timestamp")
    return events.withColumn("_t", t).withWatermark("_t", late).groupBy(F.window("_t", window), by).agg(
        F.count("*").alias("n"), F.sum("value").alias("total"))


def first_seen(rows: DataFrame, keys: list[str], time: str, late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark."""
    return rows.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(keys)
