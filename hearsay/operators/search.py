"""Search by keyword, hashtag and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.operators.ingest import filter_topic


def posts_search(
    posts: DataFrame,
    keyword: str | None = None,
    hashtag: str | None = None,
    start=None,
    end=None,
    literal: bool = False,
) -> DataFrame:
    """Posts that meet every given condition; ``start`` and ``end`` are inclusive."""
    if start is not None:
        posts = posts.filter(F.col("created_at") >= F.lit(str(start)).cast("timestamp_ntz"))
    if end is not None:
        posts = posts.filter(F.col("created_at") <= F.lit(str(end)).cast("timestamp_ntz"))
    if hashtag is not None:
        posts = posts.filter(F.array_contains("hashtags", hashtag))
    if keyword is not None:
        posts = filter_topic(posts, keyword, literal)
    return posts
