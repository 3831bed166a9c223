"""Extension (not part of the reference's own operators): detections counted as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str, by: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Tumbling counts by category; rows later than the watermark are left out, and state is dropped behind it."""
    at = stream.withColumn("__at", F.col(time).cast("timestamp"))
    out = at.withWatermark("__at", late).groupBy(F.window("__at", window).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), by, "n")


def replay(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """A stored table as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
