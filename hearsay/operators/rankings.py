"""Top-k lists and engagement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.functions.values import log_bin


def top(df: DataFrame, measure: str, *keys: str, k: int = 10) -> DataFrame:
    """First k rows by measure descending, ties by key: a distributed top-k, no full sort."""
    return df.orderBy(F.desc(measure), *keys).limit(k)


def hashtag_counts(posts: DataFrame, *by: str) -> DataFrame:
    """Uses of every tag, repeats within a post counted; counted map-side first."""
    return (
        posts.select(*by, F.explode("hashtags").alias("hashtag"))
        .groupBy(*by, "hashtag")
        .agg(F.count("*").alias("count"))
    )


def top_hashtags(posts: DataFrame, k: int = 10) -> DataFrame:
    return top(hashtag_counts(posts), "count", "hashtag", k=k)


def top_users(posts: DataFrame, k: int = 10) -> DataFrame:
    """Users with most posts, with their retweet total."""
    users = posts.groupBy("username").agg(
        F.count("post_id").alias("post_count"), F.sum("retweet_count").alias("retweets")
    )
    return top(users, "post_count", "username", k=k)


def top_influencers(posts: DataFrame, k: int = 10) -> DataFrame:
    """Users by their highest follower figure."""
    users = posts.groupBy("username").agg(F.max("user_followers").alias("user_followers"))
    return top(users, "user_followers", "username", k=k)


def engagement_points(posts: DataFrame) -> DataFrame:
    return posts.select("retweet_count", "like_count", "sentiment", "text")


def engagement_bins(posts: DataFrame) -> DataFrame:
    """Posts per sentiment and order of magnitude of retweets and likes.

    Posts with a zero on either (logarithmic) axis are left out.
    """
    return (
        posts.select(
            "sentiment",
            log_bin(F.col("retweet_count")).alias("retweet_bin"),
            log_bin(F.col("like_count")).alias("like_bin"),
        )
        .filter(F.col("retweet_bin").isNotNull() & F.col("like_bin").isNotNull())
        .groupBy("sentiment", "retweet_bin", "like_bin")
        .agg(F.count("*").alias("count"))
    )
