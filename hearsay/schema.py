"""Schemas, header names and word lists."""

from __future__ import annotations

from pyspark.sql import types as T

POST_SCHEMA = T.StructType(
    [
        T.StructField("post_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("cleaned_text", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("retweet_count", T.LongType()),
        T.StructField("like_count", T.LongType()),
        T.StructField("username", T.StringType()),
        T.StructField("user_followers", T.LongType()),
        T.StructField("location", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("hashtags", T.ArrayType(T.StringType())),
    ]
)

POST_COLUMNS = POST_SCHEMA.fieldNames()

#: Columns of a landed feed file: what a raw post holds after renaming.
FEED_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "row_key",
            "text",
            "created_at",
            "username",
            "retweet_count",
            "like_count",
            "user_followers",
            "location",
            "platform",
            "hashtags",
        )
    ]
)

IMPORT_SCHEMA = T.StructType(
    [
        T.StructField("import_id", T.StringType()),
        T.StructField("search_id", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("topic_key", T.StringType()),
        T.StructField("imported_at", T.TimestampNTZType()),
        T.StructField("source", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("n_posts", T.LongType()),
    ]
)

LEXICON_SCHEMA = T.StructType(
    [
        T.StructField("word", T.StringType()),
        T.StructField("polarity", T.DoubleType()),
        T.StructField("subjectivity", T.DoubleType()),
    ]
)

GAZETTEER_SCHEMA = T.StructType(
    [
        T.StructField("level", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
    ]
)

COUNTRY_ALIAS_SCHEMA = T.StructType(
    [T.StructField("alias", T.StringType()), T.StructField("name_short", T.StringType())]
)

ENTITY_SCHEMA = T.StructType(
    [
        T.StructField("ngram", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("type", T.StringType()),
    ]
)

# --- Fixed values: accepted CSV headers per target column -------------------
HEADER_ALIASES = {
    "text": ("Text", "text", "Tweet", "Tweet-Text"),
    "created_at": ("Date", "DateTime", "Time", "Timestamp"),
    "username": ("User", "Username", "ScreenName", "Author"),
    "retweet_count": ("Retweets",),
    "like_count": ("Likes", "Favorites"),
    "location": ("Country", "Location", "Place"),
    "platform": ("Source", "Device", "Platform"),
    "hashtags": ("Hashtags", "hashtags"),
}

# --- Fixed values: strings that a CSV cell may use for "missing" -------------
NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- Fixed values: platform names -------------------------------------------
PLATFORMS = ("Twitter", "Bluesky", "Mastodon", "Reddit", "Instagram", "Facebook", "Unknown")

# --- Fixed values: keyword lists of the sentiment rule -----------------------
DISASTER_WORDS = (
    "emergency", "disaster", "help", "urgent", "ambulance", "police",
    "flood", "earthquake", "fire", "attack", "danger", "alert", "alart", "tsunami",
    "bomb", "blast", "explosion", "crash", "accident", "casualty", "victim",
    "hospital", "rescue", "evacuate", "dangerous", "crisis",
)
HAPPY_WORDS = (
    "happy", "joy", "excited", "celebrate", "celebration", "congratulations",
    "win", "won", "victory", "success", "awesome", "amazing", "great", "good",
    "wonderful", "fantastic", "excellent", "love", "loved", "beautiful",
    "perfect", "brilliant", "outstanding", "smile", "laugh", "fun",
)
SAD_WORDS = (
    "sad", "unhappy", "depressed", "cry", "crying", "tears", "mourn",
    "grief", "loss", "miss", "regret", "sorry", "apologize", "tragic",
    "heartbroken", "devastated", "miserable", "upset", "disappointed",
)


#: Default stopwords of the word count; callers may pass their own.
STOPWORDS = (
    "a", "about", "after", "all", "also", "am", "an", "and", "any", "are", "as", "at", "be",
    "because", "been", "before", "being", "but", "by", "can", "could", "did", "do", "does", "for",
    "from", "had", "has", "have", "he", "her", "here", "him", "his", "how", "i", "if", "in", "into",
    "is", "it", "its", "just", "me", "more", "most", "my", "no", "not", "of", "on", "or", "other",
    "our", "out", "over", "she", "so", "some", "such", "than", "that", "the", "their", "them",
    "then", "there", "these", "they", "this", "those", "to", "too", "up", "was", "we", "were",
    "what", "when", "where", "which", "who", "why", "will", "with", "would", "you", "your",
)
