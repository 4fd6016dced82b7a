"""Landed feed files: what a fetch job for a platform leaves behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearsay.schema import FEED_SCHEMA

#: Files taken up per micro-batch.
DEFAULT_INTAKE = 20


def read_feed(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Landed posts as a batch; ``fmt`` is json or parquet."""
    return spark.read.schema(FEED_SCHEMA).format(fmt).load(path)


def stream_feed(
    spark: SparkSession, path: str, fmt: str = "json", files_per_trigger: int | None = DEFAULT_INTAKE
) -> DataFrame:
    """Landed posts as a stream with bounded intake per micro-batch.

    ``files_per_trigger=None`` lifts the bound, for catching up.
    """
    reader = spark.readStream.schema(FEED_SCHEMA).format(fmt)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)
