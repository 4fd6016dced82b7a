"""Windowed counts of a stream of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.operators.crisis import add_alert

#: How long late posts are waited for.
DELAY = "2 hours"


def with_event_time(posts: DataFrame, delay: str = DELAY) -> DataFrame:
    """Add ``event_time`` with a watermark; watermarks need a timestamp with zone."""
    return posts.withColumn("event_time", F.col("created_at").cast("timestamp")).withWatermark(
        "event_time", delay
    )


def _window(length: str, slide: str | None):
    return F.window("event_time", length, slide) if slide else F.window("event_time", length)


def _bounds(*rest: str) -> list:
    start, end = F.col("window.start"), F.col("window.end")
    return [
        start.cast("timestamp_ntz").alias("window_start"),
        end.cast("timestamp_ntz").alias("window_end"),
        *rest,
    ]


def volume(posts: DataFrame, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Posts per window."""
    counts = posts.groupBy(_window(length, slide)).agg(F.count("*").alias("count"))
    return counts.select(*_bounds("count"))


def hashtags(posts: DataFrame, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Uses of every tag per tumbling or sliding window."""
    tags = posts.select("event_time", F.explode("hashtags").alias("hashtag"))
    counts = tags.groupBy(_window(length, slide), "hashtag").agg(F.count("*").alias("count"))
    return counts.select(*_bounds("hashtag", "count"))


def crisis(posts: DataFrame, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Crisis score and alert per window."""
    counts = posts.groupBy(_window(length, slide)).agg(
        F.count_if(F.col("sentiment") == "Disaster").alias("disaster_posts"),
        F.count("*").alias("total_posts"),
    )
    return add_alert(counts.select(*_bounds("disaster_posts", "total_posts")))


def drop_repeats(posts: DataFrame, key: str = "post_id", salts: int = 16) -> DataFrame:
    """Keep one copy of each post fetched repeatedly, within the watermark.

    Two exact steps: the first drops copies per (key, salt), so a post that
    makes up much of the stream is spread over ``salts`` tasks; the second sees
    at most ``salts`` rows of a key per watermark span.
    """
    salted = posts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    return (
        salted.dropDuplicatesWithinWatermark([key, "_salt"]).drop("_salt").dropDuplicatesWithinWatermark([key])
    )
