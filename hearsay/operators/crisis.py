"""Crisis detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.functions.alerts import alert_state, crisis_score


def crisis(posts: DataFrame, *by: str) -> DataFrame:
    """Disaster posts, all posts, score and alert state, overall or per group."""
    counts = posts.groupBy(*by).agg(
        F.count_if(F.col("sentiment") == "Disaster").alias("disaster_posts"),
        F.count("*").alias("total_posts"),
    )
    return add_alert(counts)


def add_alert(counts: DataFrame) -> DataFrame:
    return counts.withColumn(
        "crisis_score", crisis_score(F.col("disaster_posts"), F.col("total_posts"))
    ).withColumn("alert", alert_state(F.col("crisis_score")))


def disaster_sample(posts: DataFrame, k: int = 15) -> DataFrame:
    """The first k disaster posts in time order."""
    return (
        posts.filter(F.col("sentiment") == "Disaster")
        .orderBy("created_at", "post_id")
        .limit(k)
        .select("text", "sentiment", "platform")
    )
