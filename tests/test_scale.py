"""Skewed input gives whole results, and plans keep the shape that large data needs."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hearsay import session as sessions
from hearsay.operators import geography, language, rankings
from hearsay.operators.ingest import normalise
from hearsay.operators.sentiment import classify
from hearsay.plans.imports import import_csv, prepare
from hearsay.schema import LEXICON_SCHEMA
from hearsay.sources.csv import write_posts_csv
from hearsay.sources.store import PostStore
from hearsay.streaming import sinks

from support import NOW

N = 3000


@pytest.fixture(scope="module")
def skewed_raw(spark):
    """A third of all posts share text, author, tag and place."""
    hot = F.col("id") % 3 == 0
    cold = lambda prefix, m: F.concat(F.lit(prefix), (F.col("id") % m).cast("string"))
    return spark.range(N).select(
        F.col("id").cast("string").alias("idx"),
        F.when(hot, "nice nice hot #hot").otherwise(F.concat(cold("bad w", 40), F.lit(" #"), cold("t", 50))).alias("text"),
        F.when(hot, "star").otherwise(cold("u", 70)).alias("username"),
        F.when(hot, "Hub, Land").otherwise(F.concat(cold("c", 30), F.lit(", Land"))).alias("location"),
    )


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([("nice", 0.6, 1.0), ("bad", -0.7, 1.0)], LEXICON_SCHEMA)


@pytest.fixture(scope="module")
def skewed(skewed_raw, lexicon):
    return prepare(skewed_raw, NOW, None, lexicon, row_key="idx").cache()


def test_hot_keys_are_counted_whole(skewed):
    rows = skewed.collect()
    top = lambda counter: sorted(counter.items(), key=lambda x: (-x[1], x[0]))[:10]
    tags = Counter(t for r in rows for t in r.hashtags)
    assert [tuple(r) for r in rankings.top_hashtags(skewed).collect()] == top(tags)
    assert [tuple(r)[:2] for r in rankings.top_users(skewed).collect()] == top(Counter(r.username for r in rows))
    places = geography.place_breakdown(skewed).filter("level = 'city'").orderBy("rank").collect()
    assert [(r.name, r["count"]) for r in places] == top(Counter(r.city for r in rows))
    words = {r.word: r["count"] for r in language.word_counts(skewed).collect()}
    assert words["nice"] == 2 * N / 3 and words["bad"] == 2 * N / 3 and words["hot"] == 2 * N / 3


def test_hot_words_in_a_joined_lexicon(skewed, lexicon):
    again = classify(skewed.drop("sentiment"), lexicon, literal_rows=0)
    assert {tuple(r) for r in again.groupBy("sentiment").count().collect()} == {
        ("Positive", N // 3),
        ("Negative", 2 * N // 3),
    }
    assert again.join(skewed, ["post_id", "sentiment"]).count() == N


def test_spread_changes_the_plan_but_no_row(spark, skewed_raw, lexicon, skewed):
    spread = prepare(skewed_raw, NOW, None, lexicon, row_key="idx", spread=True)
    assert "REBALANCE" in spread._jdf.queryExecution().executedPlan().toString()
    assert spread.exceptAll(skewed).count() == 0 and spread.count() == N


@pytest.mark.parametrize("multiline", [True, False])
def test_import_of_one_big_file(spark, skewed_raw, tmp_path, multiline):
    write_posts_csv(skewed_raw.coalesce(1), str(tmp_path / "csv"))
    store = PostStore(spark, str(tmp_path / "store")).create()
    import_csv(store, str(tmp_path / "csv"), "#", NOW, multiline=multiline, row_key="idx")
    assert store.topic_posts("#").count() == N


def test_no_query_hints_a_broadcast(spark, sf_dir):
    from checks.queries import QUERIES

    for name in ("enrich_posts", "heat_points", "standard_countries", "entity_counts", "document_entities_by_join",
                 "document_words", "sentiment_class_by_join", "stored_posts", "known_topics"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().analyzed().toString()
        assert "strategy=broadcast" not in plan, name


def test_shared_folder_is_the_checkpoint_folder(spark):
    class Session:
        """What shared_folder asks of a session on a cluster."""

        def __init__(self, folder):
            self.conf = {"spark.checkpoint.dir": folder} if folder else {}
            self.sparkContext = type("Context", (), {"master": "yarn"})

    assert sessions.shared_folder(Session("/shared/x/")) == "/shared/x"
    assert sessions.fresh_folder(Session("/shared/x"), "a").startswith("/shared/x/a-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        sessions.shared_folder(Session(None))
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert sessions.shared_folder(spark) == (named.rstrip("/") if named else spark.conf.get("spark.hearsay.localFolder"))


def test_unreadable_times_without_a_fixed_ingest_time(spark, tmp_path):
    rows = spark.createDataFrame([("a", "?"), ("b", "2024-01-01")], "text string, created_at string")
    got = {r.text: r.created_at for r in normalise(rows).collect()}
    assert got["b"] == dt.datetime(2024, 1, 1)
    assert abs(got["a"] - dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)) < dt.timedelta(minutes=2)
    rows.write.json(str(tmp_path / "in"))
    stream = prepare(spark.readStream.schema(rows.schema).json(str(tmp_path / "in"))).select("text", "created_at")
    sinks.start(
        stream, sinks.batches_to(str(tmp_path / "out")), str(tmp_path / "c"), "append", refresh_minutes=None
    ).awaitTermination()
    late = {r.text: r.created_at for r in sinks.all_rows(spark, str(tmp_path / "out"), stream.schema).collect()}
    assert got["a"] <= late["a"] <= got["a"] + dt.timedelta(minutes=2)


def test_split_records_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from checks import queries

    rows = [(i, f'line {i}\nand "more", of it\n' * (i % 3)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    tasks = []
    write = lambda df, path: (tasks.append(df.rdd.getNumPartitions()), write_posts_csv(df, path))
    monkeypatch.setattr(queries, "write_posts_csv", write)
    got = queries.csv_split_records(spark, str(tmp_path))
    assert tasks[0] > 1
    want = docs.selectExpr("doc_id", "md5(nullif(text, '')) AS digest")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
