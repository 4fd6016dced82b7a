"""Posts and lookup tables derived from the driver tables.

The tables hold nothing post-like, so raw posts are built from ``events`` and
the customer's place. The expressions are plain SQL that Spark and DuckDB read
alike; the SQL counterparts start from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.schema import ENTITY_SCHEMA, LEXICON_SCHEMA

INGEST_TS = "2024-02-01 00:00:00"

TEXT = """(CASE WHEN event_id % 7 = 0 THEN 'RT @user' || CAST(user_id AS STRING) || ' ' ELSE '' END)
 || (CASE event_id % 20
      WHEN 0 THEN 'Fire alert near the hospital'
      WHEN 1 THEN 'What a great victory'
      WHEN 2 THEN 'So sorry for the loss'
      WHEN 3 THEN 'terrible service'
      WHEN 4 THEN 'nice and pleasant'
      WHEN 5 THEN 'an unhappy day'
      ELSE 'plain words about ' || event_type END)
 || ' #' || event_type || ' #k' || CAST(event_id % 17 AS STRING)
 || (CASE WHEN event_id % 5 = 0 THEN ' https://ex.org/' || CAST(event_id AS STRING) ELSE '' END)"""

#: Column of the raw view -> expression over events (and the place columns).
RAW_COLUMNS = {
    "idx": "event_id",
    "text_": TEXT,
    "time_": """CASE WHEN event_id % 97 = 0 THEN 'not a date'
      ELSE CAST(CAST(date_trunc('second', ts) AS TIMESTAMP) AS STRING) END""",
    "user_": "'user' || CAST(user_id AS STRING)",
    "retweets_": """CASE WHEN event_id % 50 = 0 THEN 'n/a'
      ELSE CAST(CAST(floor(value) AS BIGINT) AS STRING) END""",
    "likes_": "CAST(value AS STRING)",
    "followers_": "CAST((user_id * 37 + event_id % 5) % 5000 AS STRING)",
    "hashtags_": """CASE event_id % 4
      WHEN 0 THEN '[''' || event_type || ''',''k' || CAST(event_id % 17 AS STRING) || ''']'
      WHEN 1 THEN '#extra #' || event_type
      WHEN 2 THEN '' ELSE NULL END""",
    "location_": """CASE event_id % 6
      WHEN 0 THEN NULL
      WHEN 1 THEN c_mktsegment || ', ' || n_name || ', ' || r_name
      WHEN 2 THEN n_name || ', ' || r_name
      WHEN 3 THEN r_name
      WHEN 4 THEN 'a, b, c, d' ELSE ' ' END""",
    "platform_": """CASE event_id % 9
      WHEN 0 THEN 'twitter' WHEN 1 THEN 'Bluesky ' WHEN 2 THEN 'MASTODON' WHEN 3 THEN 'reddit'
      WHEN 4 THEN 'Instagram' WHEN 5 THEN 'facebook' WHEN 6 THEN '' WHEN 7 THEN 'nan' ELSE 'Threads' END""",
}

#: The headers under which the raw columns enter the library.
HEADERS = {
    "text_": "Text",
    "time_": "Timestamp",
    "user_": "User",
    "retweets_": "Retweets",
    "likes_": "Likes",
    "followers_": "user_followers",
    "hashtags_": "Hashtags",
    "location_": "Location",
    "platform_": "Platform",
}

LEXICON = [
    ("terrible", -1.0, 1.0),
    ("nice", 0.6, 1.0),
    ("pleasant", 0.733333, 0.966667),
    ("plain", -0.214286, 0.357143),
    ("words", 0.05, 0.1),
    # frequent words of the document corpus, so that its texts differ
    ("the", 0.11, 0.2),
    ("and", 0.13, 0.2),
    ("la", -0.3, 0.4),
    ("les", 0.2, 0.4),
    ("der", -0.25, 0.4),
    ("und", 0.15, 0.4),
    ("de", -0.12, 0.4),
    ("los", 0.4, 0.4),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, c_mktsegment, n_name, r_name); nation and region are a few rows each."""
    t = lambda name: table(spark, sf_dir, name)
    return (
        t("customer")
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select("c_custkey", "c_mktsegment", "n_name", "r_name")
    )


def raw_posts(spark: SparkSession, sf_dir: str, places: bool = True) -> DataFrame:
    """All events as raw posts under CSV headers.

    ``places=False`` leaves the location empty and with it out the join, for
    queries that look at no place. The join is left to Spark: broadcast while
    the customers are small, else sorted with skewed users split by AQE.
    """
    return as_raw(table(spark, sf_dir, "events"), customer_places(spark, sf_dir) if places else None)


def as_raw(events: DataFrame, places: DataFrame | None = None) -> DataFrame:
    columns = dict(RAW_COLUMNS)
    if places is None:
        columns["location_"] = "CAST(NULL AS STRING)"
    else:
        events = events.join(places, F.col("user_id") == F.col("c_custkey"), "left")
    return events.select(
        [F.expr(sql).alias(HEADERS.get(name, name)) for name, sql in columns.items()]
    )


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, LEXICON_SCHEMA)


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of segments, nations and regions; every fifth nation is missing."""
    nations = table(spark, sf_dir, "nation").filter("n_nationkey % 5 <> 4")
    segments = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    at = lambda key: [
        (F.col(key).cast("double") * 3 - 40).alias("lat"),
        (F.col(key).cast("double") * 7 - 90).alias("lon"),
    ]
    return (
        segments.select(
            F.lit("city").alias("level"),
            F.col("c_mktsegment").alias("name"),
            F.length("c_mktsegment").alias("key"),
        )
        .select("level", "name", *at("key"))
        .unionByName(nations.select(F.lit("city").alias("level"), F.col("n_name").alias("name"), *at("n_nationkey")))
        .unionByName(nations.select(F.lit("state").alias("level"), F.col("n_name").alias("name"), *at("n_nationkey")))
        .unionByName(
            country_aliases(spark, sf_dir).select(
                F.lit("country").alias("level"), F.col("name_short").alias("name"), *at("r_regionkey")
            )
        )
    )


def country_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard names of every other region; the rest are standard already."""
    return table(spark, sf_dir, "region").select(
        F.col("r_name").alias("alias"),
        F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("Region "), F.col("r_name")))
        .otherwise(F.col("r_name"))
        .alias("name_short"),
        "r_regionkey",
    )


def post_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that occur in the posts: the event types and three phrases."""
    phrases = spark.createDataFrame(
        [
            ("the hospital", "Hospital", "FAC"),
            ("great victory", "Victory", "EVENT"),
            ("sorry for the", "Condolence", "PHRASE"),
        ],
        ENTITY_SCHEMA,
    )
    types = table(spark, sf_dir, "events").select("event_type").distinct()
    return types.select(
        F.col("event_type").alias("ngram"), F.upper("event_type").alias("entity"), F.lit("ACTION").alias("type")
    ).unionByName(phrases)


def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a whole, as it is written, and one to six tokens of each."""
    from hearsay.functions.text import entity_tokens

    items = table(spark, sf_dir, "benchmark").select(
        "item_id", "text", entity_tokens(F.col("text")).alias("w"), F.col("item_id").cast("string").alias("entity")
    )
    part = F.slice("w", (F.col("item_id") % 5 + 1).cast("int"), (F.col("item_id") % 6 + 1).cast("int"))
    return items.select(F.col("text").alias("ngram"), "entity", F.lit("ITEM").alias("type")).unionByName(
        items.select(F.array_join(part, ", ").alias("ngram"), "entity", F.lit("PART").alias("type"))
    )


def large_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polarity for every word of the documents: more words than become literals of a plan."""
    from hearsay.functions.text import words

    found = table(spark, sf_dir, "documents").select(F.explode(words(F.col("text"))).alias("word")).distinct()
    polarity = (F.length("word") * 37 % 21 - 10) / F.lit(10.0)
    return found.select("word", polarity.alias("polarity"), F.lit(0.5).alias("subjectivity"))


#: Form of a time -> (pattern, what it keeps of a time), chosen by ``event_id``.
TIME_FORMS = (
    ("M/d/yyyy h:mm a", "minute"),
    ("MMMM d, yyyy", "day"),
    ("EEE, dd MMM yyyy HH:mm:ss 'GMT'", "second"),
    ("dd-MMM-yyyy", "day"),
    ("MMM d yyyy h:mma", "minute"),
    ("yyyy/MM/dd HH:mm:ss.SSS", "millisecond"),
    ("MM.dd.yyyy", "day"),
    ("yyyyMMdd", "day"),
    ("yyyy-MM-dd HH:mm 'UTC'", "minute"),
    ("M/d/yy", "day"),
    ("EEE MMM dd HH:mm:ss '+0000' yyyy", "second"),
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", "second"),
    ("dd MMM yyyy HH:mm", "minute"),
    ("yyyyMMdd'T'HHmmss", "second"),
    ("yyyyMMddHHmmss", "second"),
    ("MMM yyyy", "month"),
    ("M/yyyy", "month"),
    ("d MMMM yyyy 'at' H:mm", "minute"),
    ("MMMM d'th', yyyy h a", "hour"),
)

#: Headers of three exports of the same posts; what a set leaves out is missing in its files.
HEADER_SETS = (
    {"Text": "Text", "Timestamp": "Timestamp", "User": "User", "Retweets": "Retweets", "Likes": "Likes",
     "user_followers": "user_followers", "Hashtags": "Hashtags", "Location": "Location", "Platform": "Platform", "idx": "idx"},
    {"User": "Author", "Likes": "Favorites", "Text": "Tweet", "Location": "Place", "Platform": "Source", "idx": "idx",
     "Timestamp": "Date", "Hashtags": "hashtags"},
    {"idx": "idx", "Text": "Tweet-Text", "User": "Username", "Timestamp": "DateTime"},
)
