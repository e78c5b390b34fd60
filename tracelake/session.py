"""Session settings that every part relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def build(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()
