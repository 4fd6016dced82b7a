"""Raw rows to typed, enriched posts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions import places, text, values
from hearsay.operators.sentiment import classify
from hearsay.schema import HEADER_ALIASES, POST_COLUMNS

#: Value of a target column that no header provides.
DEFAULTS = {
    "created_at": None,  # read as the ingest time
    "retweet_count": "0",
    "like_count": "0",
    "username": "unknown",
    "user_followers": "0",
    "location": None,
    "platform": "unknown",
    "hashtags": "",
}


def alias_columns(df: DataFrame, on_collision: str = "error") -> DataFrame:
    """Rename known headers to the target names; other columns stay.

    Several headers for one target raise an error, or with
    ``on_collision='coalesce'`` the first non-null of them wins.
    """
    # by place: names that differ in case alone are one name to Spark
    places = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    at = {name: F.col(f"_{i}") for i, name in enumerate(df.columns)}
    targets: dict[str, str] = {}
    merged: dict[str, Column] = {}
    for target, headers in HEADER_ALIASES.items():
        found = [h for h in dict.fromkeys((target, *headers)) if h in at]
        if len(found) > 1 and on_collision != "coalesce":
            raise ValueError(f"columns {found} all stand for '{target}'")
        if found:
            targets |= dict.fromkeys(found, target)
            merged[target] = F.coalesce(*[at[h] for h in found])
    out = []
    for name in df.columns:
        target = targets.get(name)
        if target is None:
            out.append(at[name].alias(name))
        elif target in merged:
            out.append(merged.pop(target).alias(target))
    return places.select(out)


def require_text(df: DataFrame) -> DataFrame:
    if "text" not in df.columns:
        raise ValueError("the input needs a text column with the post content")
    return df


def fill_defaults(df: DataFrame) -> DataFrame:
    """Add each missing target column with its default."""
    return df.withColumns(
        {c: F.lit(v).cast("string") for c, v in DEFAULTS.items() if c not in df.columns}
    )


def filter_topic(df: DataFrame, topic: str, literal: bool = False, text_column: str = "text") -> DataFrame:
    """Rows whose text contains the topic, ignoring case; null text never matches.

    The topic is a regular expression unless ``literal`` is set.
    """
    lowered = F.lower(F.col(text_column))
    found = lowered.contains(topic.lower()) if literal else lowered.rlike(topic.lower())
    return df.filter(found)


def unreadable_times(df: DataFrame) -> DataFrame:
    """(unreadable, posts): how many posts have a time that can't be read and will get the ingest time."""
    df = fill_defaults(alias_columns(df))
    return df.agg(F.count_if(values.unreadable_time(F.col("created_at"))).alias("unreadable"), F.count("*").alias("posts"))


def normalise(
    df: DataFrame,
    ingest_ts: dt.datetime | str | None = None,
    row_key: str | None = None,
    on_collision: str = "error",
) -> DataFrame:
    """All-string rows under any accepted header to typed columns.

    Posts without a readable time get ``ingest_ts``; None stands for the time of
    the query, in a stream for that of each micro-batch.

    ``post_id`` is a digest of the row key and the text. Without a key column
    it covers author, time and text, so that a post fetched again keeps its id.
    """
    df = fill_defaults(require_text(alias_columns(df, on_collision)))
    ingest = F.localtimestamp() if ingest_ts is None else F.lit(str(ingest_ts)).cast("timestamp_ntz")
    key = [F.col(row_key).cast("string")] if row_key else [F.col("username"), F.col("created_at")]
    return df.select(
        F.md5(F.concat_ws("\u0001", *key, F.col("text"))).alias("post_id"),
        F.col("text"),
        values.to_time(F.col("created_at"), ingest).alias("created_at"),
        values.to_count(F.col("retweet_count")).alias("retweet_count"),
        values.to_count(F.col("like_count")).alias("like_count"),
        F.coalesce(F.col("username"), F.lit("unknown")).alias("username"),
        values.to_count(F.col("user_followers")).alias("user_followers"),
        F.nullif(F.col("location"), F.lit("")).alias("location"),
        values.canonical_platform(F.col("platform")).alias("platform"),
        F.coalesce(F.col("hashtags"), F.lit("")).alias("hashtags"),
    )


def enrich(
    df: DataFrame,
    lexicon: DataFrame | None = None,
    match: str = "substring",
    strip_hash: bool = False,
) -> DataFrame:
    """Normalised rows to full post records: one narrow pass, no shuffle.

    (A lexicon too large for literals is joined instead, see ``classify``.)
    """
    out = df.withColumns(
        {
            "cleaned_text": text.clean_text(F.col("text")),
            "hashtags": text.hashtag_bag(F.col("hashtags"), F.col("text"), strip_hash),
            "_parts": places.place_parts(F.col("location")),
            "year": F.year("created_at"),
            "month": F.month("created_at"),
            "day": F.dayofmonth("created_at"),
            "hour": F.hour("created_at"),
        }
    )
    out = classify(out, lexicon, match=match)
    return out.withColumns(places.parse_location(F.col("location"), F.col("_parts"))).select(*POST_COLUMNS)
