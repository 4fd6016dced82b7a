"""Every registered query: (session, folder of the driver tables) -> DataFrame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import derived
from hearsay.functions import text as text_functions
from hearsay.functions import places as place_functions
from hearsay.functions import values as value_functions
from hearsay.operators import crisis, distributions, geography, language, rankings
from hearsay.operators.ingest import filter_topic, normalise
from hearsay.operators import search, topics
from hearsay.operators.sentiment import add_polarity, classify, join_polarity
from hearsay.plans.imports import import_csv, prepare
from hearsay.schema import FEED_SCHEMA, HEADER_ALIASES
from hearsay.session import fresh_folder
from hearsay.sources.csv import read_posts_csv, write_posts_csv
from hearsay.sources.feeds import stream_feed
from hearsay.sources.scratch import written
from hearsay.sources.store import PostStore
from hearsay.streaming import sinks, windows

#: Topics of the crisis query; each makes another alert state on the derived posts.
CRISIS_TOPICS = {"all": ".", "mixed": "plain|near|great", "links": "https", "plain": "plain"}

#: Imports of the stored example: (import id, topic, time, span of a recent search in hours).
IMPORTS = [
    ("i1", "#click", dt.datetime(2024, 2, 1, 0, 0), None),
    ("i2", "hospital", dt.datetime(2024, 2, 1, 0, 20), None),
    ("i3", "#CLICK", dt.datetime(2024, 2, 1, 0, 40), None),
    ("i4", "victory", dt.datetime(2024, 2, 1, 1, 0), 1),
    ("i5", "victory", dt.datetime(2024, 2, 1, 1, 30), 1),
    ("i6", "victory", dt.datetime(2024, 2, 1, 2, 45), 1),
]


def posts(spark: SparkSession, sf_dir: str, places: bool = False, topic: str | None = None) -> DataFrame:
    return prepare(
        derived.raw_posts(spark, sf_dir, places), derived.INGEST_TS, topic, derived.lexicon(spark), row_key="idx"
    )


def _joined_tags(df: DataFrame) -> DataFrame:
    return df.withColumn("hashtags", F.array_join("hashtags", "|"))


# -- projections ---------------------------------------------------------------


def normalise_posts(spark, sf_dir):
    return normalise(derived.raw_posts(spark, sf_dir), derived.INGEST_TS, "idx")


def clean_text(spark, sf_dir):
    raw = derived.raw_posts(spark, sf_dir, places=False)
    return raw.select("idx", text_functions.clean_text(F.col("Text")).alias("cleaned_text"))


def clean_documents(spark, sf_dir):
    docs = derived.table(spark, sf_dir, "documents")
    cleaned = text_functions.clean_text(F.col("text"))
    return docs.select("doc_id", F.md5(cleaned).alias("digest"), F.length(cleaned).alias("length"))


def sentiment_class(spark, sf_dir):
    return posts(spark, sf_dir).select("post_id", "sentiment")


def sentiment_class_by_join(spark, sf_dir):
    """The same classes with the lexicon joined, as a large one would be."""
    cleaned = normalise(derived.raw_posts(spark, sf_dir, False), derived.INGEST_TS, "idx").select(
        "post_id", text_functions.clean_text(F.col("text")).alias("cleaned_text")
    )
    return classify(cleaned, derived.lexicon(spark), literal_rows=0).select("post_id", "sentiment")


def document_sentiment(spark, sf_dir):
    docs = derived.table(spark, sf_dir, "documents").select(
        "doc_id", "lang", text_functions.clean_text(F.col("text")).alias("cleaned_text")
    )
    return distributions.count_by(classify(docs, derived.lexicon(spark)), "lang", "sentiment")


def conversation_sentiment(spark, sf_dir):
    turns = derived.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", text_functions.clean_text(F.col("text")).alias("cleaned_text")
    )
    return distributions.count_by(classify(turns, derived.lexicon(spark)), "role", "sentiment")


def conversation_sentiment_by_join(spark, sf_dir):
    """The same counts with the lexicon joined; turns repeat in every conversation."""
    turns = derived.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", text_functions.clean_text(F.col("text")).alias("cleaned_text")
    )
    return distributions.count_by(classify(turns, derived.lexicon(spark), literal_rows=0), "role", "sentiment")


def whole_word_sentiment(spark, sf_dir):
    docs = derived.table(spark, sf_dir, "documents").select(
        "doc_id", text_functions.clean_text(F.col("text")).alias("cleaned_text")
    )
    return classify(docs, None, match="word").select("doc_id", "sentiment")


def lexicon_polarity(spark, sf_dir):
    docs = derived.table(spark, sf_dir, "documents").select("doc_id", "text")
    return add_polarity(docs, derived.lexicon(spark), "text").select("doc_id", "polarity")


def lexicon_polarity_by_join(spark, sf_dir):
    docs = derived.table(spark, sf_dir, "documents").select("doc_id", "text")
    return join_polarity(docs, derived.lexicon(spark), "text").select("doc_id", "polarity")


def hashtag_bag(spark, sf_dir):
    raw = derived.raw_posts(spark, sf_dir, places=False)
    bag = text_functions.hashtag_bag(F.col("Hashtags"), F.col("Text"))
    return raw.select("idx", F.array_join(bag, "|").alias("hashtags"))


def parse_location(spark, sf_dir):
    raw = derived.raw_posts(spark, sf_dir)
    split = raw.select("idx", "Location", place_functions.place_parts(F.col("Location")).alias("parts"))
    return split.withColumns(place_functions.parse_location(F.col("Location"), F.col("parts"))).drop("Location", "parts")


def date_parts(spark, sf_dir):
    return posts(spark, sf_dir).select("post_id", "created_at", "year", "month", "day", "hour")


def enrich_posts(spark, sf_dir):
    return _joined_tags(posts(spark, sf_dir, places=True))


def csv_posts(spark, sf_dir):
    """Raw posts written as CSV, read back and normalised."""
    path = fresh_folder(spark, "csv")
    raw = derived.raw_posts(spark, sf_dir)
    write_posts_csv(raw.withColumn("idx", F.col("idx").cast("string")), path)
    return normalise(read_posts_csv(spark, path), derived.INGEST_TS, "idx")


def time_forms(spark, sf_dir):
    """The events' times in many ordinary forms, read back."""
    told = F.lit(None).cast("string")
    for i, (form, _) in enumerate(derived.TIME_FORMS):
        told = F.when(F.col("event_id") % len(derived.TIME_FORMS) == i, F.date_format("ts", form)).otherwise(told)
    events = derived.table(spark, sf_dir, "events")
    read = value_functions.to_time(told, F.lit(derived.INGEST_TS))
    return events.select("event_id", read.alias("read_ts"), value_functions.unreadable_time(told).alias("unreadable"))


def csv_mixed_headers(spark, sf_dir):
    """Posts in three exports with other headers, order and columns, odd names, and a header that repeats a name."""
    folder = fresh_folder(spark, "csv")
    raw = derived.raw_posts(spark, sf_dir).withColumn("idx", F.col("idx").cast("string"))
    paths = [f"{folder}/{name}" for name in ("an export", "export [2]", "100% export")]
    for i, (headers, path) in enumerate(zip(derived.HEADER_SETS, paths)):
        part = raw.filter(F.col("idx").cast("bigint") % len(derived.HEADER_SETS) == i)
        part = part.select([F.col(c).alias(h) for c, h in headers.items()])
        if i < 2:
            write_posts_csv(part, path)
        else:
            again = F.struct(*part.columns, F.lit("someone else").alias("again"))
            lines = part.select(F.lit(1).alias("at"), F.to_csv(again, {"quoteAll": "true", "escape": '"'}).alias("value"))
            header = spark.createDataFrame([(0, ",".join([*part.columns, "Username"]))], "at int, value string")
            header.unionByName(lines).repartition(1).sortWithinPartitions("at").select("value").write.text(path)
    return normalise(read_posts_csv(spark, paths), derived.INGEST_TS, "idx", on_collision="coalesce")


def csv_split_records(spark, sf_dir):
    """The documents, whose texts hold line breaks, as CSV files that are each read in many byte ranges; a task writes one."""
    path, size = fresh_folder(spark, "csv"), "spark.sql.files.maxPartitionBytes"
    docs = derived.table(spark, sf_dir, "documents")
    write_posts_csv(docs.select(F.col("doc_id").cast("string").alias("idx"), F.col("text").alias("Text")), path)
    before = spark.conf.get(size)
    spark.conf.set(size, str(1 << 18))
    try:
        rows = written(read_posts_csv(spark, path), "split-records")
    finally:
        spark.conf.set(size, before)
    return rows.select(F.col("idx").cast("bigint").alias("doc_id"), F.md5("Text").alias("digest"))


def required_column(spark, sf_dir):
    """Posts read with their text under each accepted header, and the refusal without one."""
    raw = derived.raw_posts(spark, sf_dir, places=False).select("idx", F.col("Text").alias("_text"))
    out = []
    for header in (*HEADER_ALIASES["text"], "Message"):
        try:
            read = normalise(raw.withColumnRenamed("_text", header), derived.INGEST_TS, "idx")
            found = read.agg(F.count("text").alias("posts")).withColumn("refusal", F.lit(None).cast("string"))
        except ValueError as e:
            found = raw.agg(F.count("*").alias("posts")).select(F.lit(0).cast("long").alias("posts"), F.lit(str(e)).alias("refusal"))
        out.append(found.select(F.lit(header).alias("header"), "posts", "refusal"))
    return reduce(DataFrame.unionByName, out)


# -- filters -------------------------------------------------------------------


def topic_filter(spark, sf_dir):
    raw = derived.raw_posts(spark, sf_dir, places=False)
    return filter_topic(raw, "Near The|#K1[23]\\b", text_column="Text").select("idx", "Text").withColumnsRenamed(
        {"Text": "text"}
    )


def topic_filter_literal(spark, sf_dir):
    docs = derived.table(spark, sf_dir, "documents")
    return filter_topic(docs, "The ", literal=True).select("doc_id", "lang")


def posts_search(spark, sf_dir):
    found = search.posts_search(
        posts(spark, sf_dir), "service|victory", "click", "2024-01-05 00:00:00", "2024-01-20 12:00:00"
    )
    return found.select("post_id", "text", "created_at", "sentiment")


# -- counts --------------------------------------------------------------------


def sentiment_counts(spark, sf_dir):
    return distributions.sentiment_counts(posts(spark, sf_dir))


def sentiment_metrics(spark, sf_dir):
    counts = distributions.count_by(posts(spark, sf_dir), "sentiment")
    return distributions.sentiment_metrics(counts)


def sentiment_metrics_read(spark, sf_dir):
    counts = distributions.count_by(posts(spark, sf_dir), "sentiment")
    return distributions.read_sentiment_metrics(distributions.sentiment_metrics(counts))


def key_metrics(spark, sf_dir):
    return distributions.key_metrics(posts(spark, sf_dir))


def platform_distribution(spark, sf_dir):
    return distributions.platform_distribution(posts(spark, sf_dir))


def hourly_volume(spark, sf_dir):
    return distributions.hourly_volume(posts(spark, sf_dir))


def top_hashtags(spark, sf_dir):
    return rankings.top_hashtags(posts(spark, sf_dir))


def top_users(spark, sf_dir):
    return rankings.top_users(posts(spark, sf_dir))


def top_influencers(spark, sf_dir):
    return rankings.top_influencers(posts(spark, sf_dir))


def engagement_points(spark, sf_dir):
    return rankings.engagement_points(posts(spark, sf_dir))


def engagement_bins(spark, sf_dir):
    return rankings.engagement_bins(posts(spark, sf_dir))


def crisis_score(spark, sf_dir):
    """Score and alert of each topic, in one pass over the posts."""
    found = posts(spark, sf_dir).select(
        "sentiment",
        F.explode(
            F.filter(
                F.array(
                    *[
                        F.when(F.lower("text").rlike(pattern), F.lit(name))
                        for name, pattern in CRISIS_TOPICS.items()
                    ]
                ),
                lambda t: t.isNotNull(),
            )
        ).alias("topic"),
    )
    return crisis.crisis(found, "topic")


def crisis_by_platform(spark, sf_dir):
    return crisis.crisis(posts(spark, sf_dir), "platform")


def disaster_sample(spark, sf_dir):
    return crisis.disaster_sample(posts(spark, sf_dir))


# -- language ------------------------------------------------------------------


def entity_counts(spark, sf_dir):
    counts = language.entity_counts(posts(spark, sf_dir), derived.post_entities(spark, sf_dir))
    return rankings.top(counts, "count", "entity", "type", k=20)


def entity_matches(spark, sf_dir):
    return language.match_entities(posts(spark, sf_dir), derived.post_entities(spark, sf_dir))


def document_entities(spark, sf_dir):
    docs = derived.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("cleaned_text"))
    return language.entity_counts(docs, derived.document_entities(spark, sf_dir))


def document_entities_by_join(spark, sf_dir):
    """The same counts with the entries' first tokens joined, as for a large gazetteer."""
    docs = derived.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("cleaned_text"))
    return language.entity_counts(docs, derived.document_entities(spark, sf_dir), literal_rows=0)


def entity_plug_in(spark, sf_dir):
    """Another extractor: words written in capitals."""

    def capitals(batches):
        for pdf in batches:
            found = pdf.assign(entity=pdf.cleaned_text.fillna("").str.findall(r"\b[A-Z]{2,}\b")).explode("entity")
            found = found.dropna(subset=["entity"])
            yield found[["post_id", "entity"]].assign(type="CAPITALS")

    docs = derived.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("post_id"), F.col("text").alias("cleaned_text")
    )
    return language.count_entities(language.extract_entities(docs, capitals))


def word_frequency(spark, sf_dir):
    return language.word_frequency(posts(spark, sf_dir))


def document_words(spark, sf_dir):
    """Top words of the two text corpora, with the most common tokens of the conversations stopped."""
    corpus = derived.table(spark, sf_dir, "documents").select("text").unionByName(
        derived.table(spark, sf_dir, "conversations").select("text")
    )
    stop = derived.table(spark, sf_dir, "benchmark").select(
        F.explode(text_functions.words(F.col("text"))).alias("word")
    )
    return language.word_frequency(corpus, stop, text_column="text")


def topic_terms(spark, sf_dir):
    """Documents per topic-model token."""
    docs = derived.table(spark, sf_dir, "documents")
    tokens = language.topic_tokens(docs, "text", "doc_id")
    return (
        tokens.select(F.explode(F.array_distinct("tokens")).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("documents"))
    )


def topic_model_input(spark, sf_dir):
    """Every term of every document with its count."""
    docs = derived.table(spark, sf_dir, "documents")
    return language.topic_input(language.topic_tokens(docs, "text", "doc_id"), "doc_id")


_models: dict[tuple[str, str], tuple[language.TopicModel, DataFrame, DataFrame]] = {}


def _topics(spark, sf_dir):
    """The model of the documents, fitted once per session and folder, and their tokens and blocks, written once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _models:
        docs = derived.table(spark, sf_dir, "documents")
        tokens = written(language.topic_tokens(docs, "text", "doc_id"), "topic-tokens")
        blocks = language.topic_blocks(tokens, "doc_id")
        _models[key] = language.topic_model(tokens, iterations=10, key="doc_id", blocks=blocks), tokens, blocks
    return _models[key]


def topic_model(spark, sf_dir):
    return language.describe_topics(_topics(spark, sf_dir)[0])


def topic_of_posts(spark, sf_dir):
    """Each document's topics by the stored model: shares add up to 1, and are the same when it is read again."""
    model, tokens, blocks = _topics(spark, sf_dir)
    counts, path = topics.TopicCounts.of(model), fresh_folder(spark, "topics")
    counts.save(path)
    found = topics.topic_mixture(tokens, counts, "doc_id", blocks)
    again = topics.topic_mixture(tokens, topics.TopicCounts.load(spark, path), "doc_id", blocks)
    total = F.aggregate("mixture", F.lit(0.0), lambda a, x: a + x)
    return found.join(again.withColumnRenamed("mixture", "again"), "doc_id").select(
        "doc_id",
        F.size("mixture").alias("topics"),
        (F.abs(total - 1) < 1e-9).alias("adds_up"),
        F.forall("mixture", lambda x: x > 0).alias("positive"),
        (F.col("mixture") == F.col("again")).alias("same"),
    )


def topic_model_fit(spark, sf_dir):
    """Each topic's heaviest terms are terms of the documents, with falling weights between 0 and 1."""
    model, tokens, _ = _topics(spark, sf_dir)
    described = language.describe_topics(model)
    terms = tokens.select(F.explode("tokens").alias("term")).distinct().withColumn("known", F.lit(True))
    before = F.lag("weight").over(Window.partitionBy("topic").orderBy("rank"))
    checked = described.withColumn("falling", F.coalesce(F.col("weight") <= before, F.lit(True)))
    return checked.join(terms, "term", "left").select(
        F.col("topic").cast("int").alias("topic"),
        F.col("rank").cast("int").alias("rank"),
        F.col("weight").between(0, 1).alias("in_range"),
        "falling",
        F.coalesce("known", F.lit(False)).alias("known"),
    )


# -- places --------------------------------------------------------------------


def place_counts(spark, sf_dir):
    return geography.place_counts(posts(spark, sf_dir, places=True))


def place_counts_parity(spark, sf_dir):
    return geography.place_counts(posts(spark, sf_dir, places=True), parity=True)


def standard_countries(spark, sf_dir):
    counts = geography.country_counts(posts(spark, sf_dir, places=True))
    return geography.standardise_country(
        counts, derived.country_aliases(spark, sf_dir), "country", "name_short"
    )


def heat_points(spark, sf_dir):
    return geography.heat_points(
        place_counts(spark, sf_dir), derived.gazetteer(spark, sf_dir), derived.country_aliases(spark, sf_dir)
    )


def map_centre(spark, sf_dir):
    return geography.map_centre(heat_points(spark, sf_dir))


def top_place(spark, sf_dir):
    return geography.top_place(posts(spark, sf_dir, places=True))


def place_breakdown(spark, sf_dir):
    return geography.place_breakdown(posts(spark, sf_dir, places=True))


def country_counts(spark, sf_dir):
    return geography.country_counts(posts(spark, sf_dir, places=True))


def platform_by_country(spark, sf_dir):
    return geography.platform_by_country(posts(spark, sf_dir, places=True))


def sentiment_by_country(spark, sf_dir):
    return geography.sentiment_by_country(posts(spark, sf_dir, places=True))


# -- store ---------------------------------------------------------------------

_stores: dict[tuple[str, str], PostStore] = {}


def example_store(spark: SparkSession, sf_dir: str) -> PostStore:
    """A store with :data:`IMPORTS`, built once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        store = PostStore(spark, fresh_folder(spark, "store")).create()
        for import_id, topic, at, hours in IMPORTS:
            recent = dt.timedelta(hours=hours) if hours else None
            store.write_import(
                posts(spark, sf_dir, topic=topic), topic, at, import_id=import_id, recent=recent
            )
        _stores[key] = store
    return _stores[key]


def stored_posts(spark, sf_dir):
    return _joined_tags(
        example_store(spark, sf_dir)
        .topic_posts("#Click")
        .select("import_id", "post_id", "cleaned_text", "created_at", "sentiment", "platform", "hashtags")
    )


def stored_search(spark, sf_dir):
    """Stored posts of a topic by keyword, tag and time, by platform, and by a tag that no post has."""
    store = example_store(spark, sf_dir)
    found = store.search("#click", "words", "k3", "2024-01-05 00:00:00", "2024-01-20 12:00:00")
    others = store.search("#click", platform="Bluesky", start="2024-01-28 00:00:00")
    none = store.search("#click", hashtag="never used")
    found = found.unionByName(others).unionByName(none)
    return found.select("import_id", "post_id", "created_at", "platform")


def stored_posts_latest(spark, sf_dir):
    rows = example_store(spark, sf_dir).topic_posts("victory", latest=True, exact=True)
    return rows.select("import_id", "post_id", "sentiment")


def stored_hashtags(spark, sf_dir):
    return example_store(spark, sf_dir).topic_hashtags("#click")


def stored_hashtags_parity(spark, sf_dir):
    return example_store(spark, sf_dir).topic_hashtags("#click", parity=True)


def stored_sentiment(spark, sf_dir):
    return example_store(spark, sf_dir).topic_sentiment("#click")


def stored_metrics(spark, sf_dir):
    return example_store(spark, sf_dir).topic_metrics("#click")


def stored_positive_parity(spark, sf_dir):
    return distributions.positive_posts_of_first_import(
        example_store(spark, sf_dir).topic_sentiment_imports("#click")
    )


def latest_import(spark, sf_dir):
    store = example_store(spark, sf_dir)
    return store.latest_search("#click").unionByName(store.latest_search("victory", exact=True))


def searches(spark, sf_dir):
    return example_store(spark, sf_dir).searches()


def search_history(spark, sf_dir):
    return example_store(spark, sf_dir).search_history()


def import_summary(spark, sf_dir):
    return example_store(spark, sf_dir).import_summary()


def recent_search(spark, sf_dir):
    """Searches of exactly these topics that began after two o'clock."""
    store, since = example_store(spark, sf_dir), dt.datetime(2024, 2, 1, 2, 0)
    found = [store.latest_search(t, exact=True, since=since) for t in ("#click", "victory")]
    return found[0].unionByName(found[1])


def known_topics(spark, sf_dir):
    """Which event types were imported as a topic."""
    types = derived.table(spark, sf_dir, "events").select(F.concat(F.lit("#"), "event_type").alias("topic"))
    return example_store(spark, sf_dir).known_topics(types.distinct())


def repeated_import(spark, sf_dir):
    """What is left of imports that were repeated: without tags, without posts, and as they were."""
    store = PostStore(spark, fresh_folder(spark, "store")).create()
    at = dt.datetime.fromisoformat(derived.INGEST_TS)
    some, plain = posts(spark, sf_dir, topic="#click"), posts(spark, sf_dir, topic="#click")
    plain = plain.withColumn("hashtags", F.array().cast("array<string>"))
    tries = {"tags": [some, plain], "gone": [some, some.limit(0)], "back": [plain, some.limit(0), some]}
    for import_id, frames in tries.items():
        for frame in frames:
            store.write_import(frame, import_id, at, import_id=import_id)
    left = [
        store.topic_posts(t).groupBy(F.lit(t).alias("topic")).agg(
            F.count("*").alias("n_posts"), F.coalesce(F.sum(F.size("hashtags")), F.lit(0)).alias("n_tags")
        )
        for t in tries
    ]
    listed = [store.topic_hashtags(t, k=100).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("listed")).select(F.lit(t).alias("topic"), "listed") for t in tries]
    return reduce(DataFrame.unionByName, left).join(reduce(DataFrame.unionByName, listed), "topic")


def failed_import(spark, sf_dir):
    """An import that breaks off after its posts leaves what was there: nothing, or the try before."""
    store = PostStore(spark, fresh_folder(spark, "store")).create()
    at = dt.datetime.fromisoformat(derived.INGEST_TS)
    some = posts(spark, sf_dir, topic="hospital")
    store.write_import(some, "kept", at, import_id="a")
    register = store._register
    store._register = lambda *_: (_ for _ in ()).throw(RuntimeError("broke off"))
    for topic, import_id in (("kept", "a"), ("new", "b")):
        try:
            store.write_import(posts(spark, sf_dir, topic="#click"), topic, at, import_id=import_id)
        except RuntimeError:
            pass
    store._register = register
    stored = store.topic_posts("kept").unionByName(store.topic_posts("new"))
    return stored.select("import_id", "post_id", "sentiment")


def csv_import(spark, sf_dir):
    """CSV file to stored posts, end to end; the count of each class."""
    path = fresh_folder(spark, "csv")
    raw = derived.raw_posts(spark, sf_dir)
    write_posts_csv(raw.withColumn("idx", F.col("idx").cast("string")), path)
    store = PostStore(spark, fresh_folder(spark, "store")).create()
    import_csv(
        store, path, "near|service", dt.datetime.fromisoformat(derived.INGEST_TS), derived.lexicon(spark), row_key="idx"
    )
    return store.topic_posts("near|service").select("post_id", "sentiment", "city", "country", "like_count")


def concurrent_imports(spark, sf_dir):
    """Three imports of each of four topics, at the same time from four threads: what the store then holds."""
    store = PostStore(spark, fresh_folder(spark, "store")).create()
    at = dt.datetime.fromisoformat(derived.INGEST_TS)
    topics = ("#click", "hospital", "victory", "service")

    def imports(topic):
        for i in range(3):
            store.write_import(posts(spark, sf_dir, topic=topic), topic, at + dt.timedelta(hours=i), import_id=f"{topic[-3:]}-{i}")

    with ThreadPoolExecutor(len(topics)) as pool:
        list(pool.map(imports, topics))
    stored = [store.topic_posts(t).agg(F.count("*").alias("stored")).withColumn("topic", F.lit(t)) for t in topics]
    registered = store.imports().groupBy("topic").agg(
        F.count("*").alias("imports"), F.countDistinct("search_id").alias("searches"), F.sum("n_posts").alias("n_posts")
    )
    return registered.join(reduce(DataFrame.unionByName, stored), "topic")


# -- streams -------------------------------------------------------------------


def stream_posts(spark: SparkSession, sf_dir: str, lexicon: DataFrame | None = None) -> DataFrame:
    """The events as a stream of enriched posts."""
    path = f"{sf_dir}/{{events.parquet}}"  # as a pattern, so that a single file will do
    events = spark.readStream.schema(derived.table(spark, sf_dir, "events").schema).parquet(path)
    return prepare(derived.as_raw(events), derived.INGEST_TS, None, lexicon, row_key="idx")


def stream_feed_posts(spark, sf_dir):
    """Posts landed as feed files, with places, read as a stream and searched by keyword, hashtag and time."""
    folder = fresh_folder(spark, "feed")
    names = {"idx": "row_key", "Text": "text", "Timestamp": "created_at", "User": "username", "Retweets": "retweet_count",
             "Likes": "like_count", "Hashtags": "hashtags", "Location": "location", "Platform": "platform"}
    raw = derived.raw_posts(spark, sf_dir).withColumnsRenamed(names)
    raw.select([F.col(f.name).cast("string").alias(f.name) for f in FEED_SCHEMA]).repartition(6).write.json(folder)
    landed = stream_feed(spark, folder, files_per_trigger=2)
    found = prepare(landed, derived.INGEST_TS, None, derived.lexicon(spark), row_key="row_key")
    found = search.posts_search(found, "service|victory", "click", "2024-01-05 00:00:00", "2024-01-20 12:00:00")
    return _run(spark, found.select("post_id", "text", "created_at", "sentiment", "city", "state", "country"), "append")


def stream_large_lexicon(spark, sf_dir):
    """Micro-batches classified by a lexicon too large for a stream's own plan."""
    store = PostStore(spark, fresh_folder(spark, "store")).create()
    at = dt.datetime.fromisoformat(derived.INGEST_TS)
    path = f"{sf_dir}/{{events.parquet}}"
    events = spark.readStream.schema(derived.table(spark, sf_dir, "events").schema).parquet(path)
    stream = prepare(derived.as_raw(events), derived.INGEST_TS, row_key="idx", enriched=False)
    sinks.start(
        stream,
        sinks.imports_to(store, "live", "feed", lambda: at, derived.large_lexicon(spark, sf_dir)),
        fresh_folder(spark, "checkpoint"),
        "append",
        refresh_minutes=None,
    ).awaitTermination()
    return store.topic_posts("live").select("post_id", "sentiment")


def _run(spark, stream, mode, *keys):
    """Process all available input; returns what the sink then holds."""
    folder = fresh_folder(spark, "stream")
    sinks.start(
        stream, sinks.batches_to(f"{folder}/out", *keys), f"{folder}/checkpoint", mode, refresh_minutes=None
    ).awaitTermination()
    if keys:
        return sinks.latest_rows(spark, f"{folder}/out", stream.schema, *keys)
    return sinks.all_rows(spark, f"{folder}/out", stream.schema)


def stream_volume(spark, sf_dir):
    timed = windows.with_event_time(stream_posts(spark, sf_dir))
    return _run(spark, windows.volume(timed), "update", "window_start", "window_end")


def stream_hashtags(spark, sf_dir):
    timed = windows.with_event_time(stream_posts(spark, sf_dir))
    sliding = windows.hashtags(timed, "12 hours", "6 hours")
    return _run(spark, sliding, "update", "window_start", "window_end", "hashtag")


def stream_crisis(spark, sf_dir):
    timed = windows.with_event_time(stream_posts(spark, sf_dir))
    return _run(spark, windows.crisis(timed, "1 day"), "update", "window_start", "window_end")


def stream_unique_posts(spark, sf_dir):
    """The stream united with itself; every post must come out once."""
    once = stream_posts(spark, sf_dir).select("post_id", "created_at", "sentiment")
    timed = windows.with_event_time(once.unionByName(once))
    unique = windows.drop_repeats(timed).drop("event_time")
    return _run(spark, unique, "append")


def stream_import(spark, sf_dir):
    """Stream to store: micro-batches arrive as imports."""
    store = PostStore(spark, fresh_folder(spark, "store")).create()
    at = dt.datetime.fromisoformat(derived.INGEST_TS)
    sinks.start(
        stream_posts(spark, sf_dir, derived.lexicon(spark)),
        sinks.imports_to(store, "live", "feed", lambda: at),
        fresh_folder(spark, "checkpoint"),
        "append",
        refresh_minutes=None,
    ).awaitTermination()
    return store.topic_posts("live").select("post_id", "sentiment", "platform", "like_count")


def refresh_periods(spark, sf_dir):
    """Which of the periods found in the events a live view may be refreshed in."""
    minutes = derived.table(spark, sf_dir, "events").select((F.col("event_id") % 140).cast("int").alias("minutes")).distinct()
    accepted = [m for m in range(140) if sinks.accepted_refresh(m)]
    return minutes.withColumn("accepted", F.col("minutes").isin(accepted))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        normalise_posts,
        clean_text,
        clean_documents,
        sentiment_class,
        sentiment_class_by_join,
        document_sentiment,
        conversation_sentiment,
        conversation_sentiment_by_join,
        whole_word_sentiment,
        lexicon_polarity,
        lexicon_polarity_by_join,
        hashtag_bag,
        parse_location,
        date_parts,
        enrich_posts,
        csv_posts,
        csv_mixed_headers,
        csv_split_records,
        required_column,
        time_forms,
        topic_filter,
        topic_filter_literal,
        posts_search,
        sentiment_counts,
        sentiment_metrics,
        sentiment_metrics_read,
        key_metrics,
        platform_distribution,
        hourly_volume,
        top_hashtags,
        top_users,
        top_influencers,
        engagement_points,
        engagement_bins,
        crisis_score,
        crisis_by_platform,
        disaster_sample,
        entity_counts,
        entity_matches,
        document_entities,
        document_entities_by_join,
        entity_plug_in,
        word_frequency,
        document_words,
        topic_terms,
        topic_model_input,
        topic_model,
        topic_model_fit,
        topic_of_posts,
        place_counts,
        place_counts_parity,
        standard_countries,
        heat_points,
        map_centre,
        top_place,
        place_breakdown,
        country_counts,
        platform_by_country,
        sentiment_by_country,
        stored_posts,
        stored_search,
        stored_posts_latest,
        stored_hashtags,
        stored_hashtags_parity,
        stored_sentiment,
        stored_metrics,
        stored_positive_parity,
        latest_import,
        searches,
        search_history,
        import_summary,
        recent_search,
        known_topics,
        csv_import,
        repeated_import,
        failed_import,
        concurrent_imports,
        refresh_periods,
        stream_volume,
        stream_hashtags,
        stream_crisis,
        stream_unique_posts,
        stream_import,
        stream_feed_posts,
        stream_large_lexicon,
    )
}
