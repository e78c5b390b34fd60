"""An addition beyond batch ingest: a stream over a growing directory of logs, counted in windows of event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def follow(spark: SparkSession, directory: str, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Parsed lines of files as they appear in the directory; a line parser needs no state."""
    return parse(spark.readStream.text(directory).withColumnRenamed("value", "line"))


def counts(rows: DataFrame, keys: list[str], every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows per window and key; rows later than the watermark are left out and the state of closed windows is dropped."""
    timed = rows.withColumn("time", F.col("time_created").cast("timestamp"))
    return timed.withWatermark("time", late).groupBy(F.window("time", every), *keys).agg(F.count("*").alias("rows"))
