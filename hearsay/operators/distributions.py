"""Counts, shares and key figures of a set of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.functions.values import hour_floor


def with_share(counts: DataFrame, count: str = "count", output: str = "share") -> DataFrame:
    """Add each row's share of the total.

    The total is a scalar subquery over the same aggregate, whose shuffle Spark
    reuses; a window without partitions would pull all groups into one task.
    """
    total = counts.agg(F.sum(count).cast("double")).scalar()
    return counts.withColumn(output, F.col(count) / total)


def count_by(posts: DataFrame, *columns: str) -> DataFrame:
    return posts.groupBy(*columns).agg(F.count("*").alias("count"))


def sentiment_counts(posts: DataFrame) -> DataFrame:
    return with_share(count_by(posts, "sentiment"))


def platform_distribution(posts: DataFrame) -> DataFrame:
    return with_share(count_by(posts, "platform"))


def sentiment_metrics(counts: DataFrame) -> DataFrame:
    """Sentiment counts as (metric, value) text rows."""
    return counts.select(
        F.concat(F.lit("sentiment_"), F.col("sentiment")).alias("metric"),
        F.col("count").cast("string").alias("value"),
    )


def read_sentiment_metrics(metrics: DataFrame) -> DataFrame:
    """(metric, value) text rows back to sentiment counts; other metrics are skipped."""
    return metrics.filter(F.col("metric").startswith("sentiment_")).select(
        F.regexp_replace("metric", "^sentiment_", "").alias("sentiment"),
        F.col("value").try_cast("bigint").alias("count"),
    )


def hourly_volume(posts: DataFrame) -> DataFrame:
    """Posts per started hour; hours without posts do not appear."""
    return (
        posts.filter(F.col("created_at").isNotNull())
        .groupBy(hour_floor(F.col("created_at")).alias("hour"))
        .agg(F.count("*").alias("count"))
        .orderBy("hour")
    )


def key_metrics(posts: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: posts, positive posts, mean retweets (half-even, 1 digit), platforms."""
    distinct = F.approx_count_distinct("platform") if approximate else F.count_distinct("platform")
    return posts.agg(
        F.count("*").alias("total_posts"),
        F.count_if(F.col("sentiment") == "Positive").alias("positive_posts"),
        F.bround(F.avg("retweet_count"), 1).alias("avg_retweets"),
        distinct.alias("platforms"),
    )


def positive_posts_of_first_import(counts: DataFrame) -> DataFrame:
    """Positive posts of the earliest import that has any, 0 if none has.

    ``counts`` are stored sentiment counts with their ``imported_at``.
    """
    return counts.agg(
        F.coalesce(
            F.min_by(
                F.when(F.col("sentiment") == "Positive", F.col("count")),
                F.when(F.col("sentiment") == "Positive", F.struct("imported_at", "import_id")),
            ),
            F.lit(0),
        ).alias("positive_posts")
    )
