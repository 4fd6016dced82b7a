import datetime as dt
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hearsay.functions.values import hour_floor
from hearsay.operators.crisis import crisis
from hearsay.operators.distributions import hourly_volume
from hearsay.operators.rankings import hashtag_counts
from hearsay.plans.imports import prepare
from hearsay.sources.feeds import read_feed, stream_feed
from hearsay.sources.store import PostStore
from hearsay.streaming import sinks, windows

from support import NOW


@pytest.fixture(scope="module")
def feed(spark, sf_dir, tmp_path_factory):
    """Landed JSON files, one per five days, in time order."""
    from checks import derived

    raw = derived.raw_posts(spark, sf_dir, places=False).withColumnsRenamed(
        {"idx": "row_key", "Text": "text", "Timestamp": "created_at", "User": "username", "Retweets": "retweet_count",
         "Likes": "like_count", "Hashtags": "hashtags", "Location": "location", "Platform": "platform"}
    )
    raw = raw.withColumn("row_key", F.col("row_key").cast("string")).filter("created_at <> 'not a date'").cache()
    folder = tmp_path_factory.mktemp("feed")
    for i in range(6):
        low, high = dt.date(2024, 1, 1 + 5 * i), dt.date(2024, 1, 1) + dt.timedelta(days=5 * i + 5)
        part = raw.filter((F.col("created_at") >= str(low)) & (F.col("created_at") < str(high)))
        part.coalesce(1).write.mode("append").json(str(folder / "posts"))
        time.sleep(0.05)  # the file source orders files by modification time
    return str(folder / "posts")


def batch(spark, feed):
    return prepare(read_feed(spark, feed), NOW, row_key="row_key")


def stream(spark, feed, files=1):
    return prepare(stream_feed(spark, feed, files_per_trigger=files), NOW, row_key="row_key")


def run(spark, df, tmp_path, mode, *keys):
    name = uuid.uuid4().hex
    query = sinks.start(
        df, sinks.batches_to(f"{tmp_path}/{name}"), f"{tmp_path}/c-{name}", mode, refresh_minutes=None
    )
    query.awaitTermination()
    if keys:
        return sinks.latest_rows(spark, f"{tmp_path}/{name}", df.schema, *keys), query
    return sinks.all_rows(spark, f"{tmp_path}/{name}", df.schema), query


def same(a, b):
    columns = sorted(a.columns)
    return sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))


def test_volume_equals_batch_over_several_micro_batches(spark, feed, tmp_path):
    timed = windows.with_event_time(stream(spark, feed))
    got, query = run(spark, windows.volume(timed), tmp_path, "update", "window_start", "window_end")
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 6
    expected = hourly_volume(batch(spark, feed))
    assert same(got.select(F.col("window_start").alias("hour"), "count"), expected)


def test_append_mode_gives_the_closed_windows(spark, feed, tmp_path):
    timed = windows.with_event_time(stream(spark, feed))
    got, _ = run(spark, windows.volume(timed), tmp_path, "append")
    posts = batch(spark, feed)
    last = posts.agg(F.max("created_at")).first()[0] - dt.timedelta(hours=2)
    expected = hourly_volume(posts).filter(F.col("hour") + F.expr("INTERVAL 1 HOUR") <= F.lit(last))
    assert same(got.select(F.col("window_start").alias("hour"), "count"), expected)


def test_hashtags_and_crisis_equal_batch(spark, feed, tmp_path):
    posts = batch(spark, feed).withColumn("hour", hour_floor(F.col("created_at")))
    tags, _ = run(
        spark, windows.hashtags(windows.with_event_time(stream(spark, feed))), tmp_path, "update",
        "window_start", "window_end", "hashtag",
    )
    expected = hashtag_counts(posts, "hour")
    assert same(tags.select(F.col("window_start").alias("hour"), "hashtag", "count"), expected)
    score, _ = run(
        spark, windows.crisis(windows.with_event_time(stream(spark, feed))), tmp_path, "update",
        "window_start", "window_end",
    )
    assert same(score.withColumnRenamed("window_start", "hour").drop("window_end"), crisis(posts, "hour"))


def test_sliding_windows_count_each_post_in_all_of_them(spark, feed, tmp_path):
    timed = windows.with_event_time(stream(spark, feed))
    got, _ = run(
        spark, windows.volume(timed, "1 hour", "30 minutes"), tmp_path, "update", "window_start", "window_end"
    )
    assert got.agg(F.sum("count")).first()[0] == 2 * batch(spark, feed).count()


def test_late_posts_are_dropped(spark, tmp_path):
    """A watermark reached in one micro-batch counts for late posts from the batch after the next on."""
    folder = str(tmp_path / "late")
    for text, at in (("a", "2024-01-02 12:00:00"), ("b", "2024-01-02 12:30:00"), ("late", "2024-01-01 00:00:00")):
        spark.createDataFrame([(text, at)], "text string, created_at string").coalesce(1).write.mode("append").json(folder)
        time.sleep(0.05)
    timed = windows.with_event_time(stream(spark, folder))
    got, _ = run(spark, windows.volume(timed), tmp_path, "update", "window_start", "window_end")
    assert [(r.window_start, r["count"]) for r in got.collect()] == [(dt.datetime(2024, 1, 2, 12), 2)]


@pytest.mark.parametrize("salts", [1, 16])
def test_repeats_are_dropped_within_and_across_batches(spark, feed, tmp_path, salts):
    once = stream(spark, feed).select("post_id", "created_at")
    thrice = once.unionByName(once).unionByName(once)
    unique = windows.drop_repeats(windows.with_event_time(thrice, "40 days"), salts=salts)
    got, _ = run(spark, unique.drop("event_time"), tmp_path, "append")
    assert same(got, batch(spark, feed).select("post_id", "created_at"))


def test_one_post_repeated_very_often(spark, tmp_path):
    rows = [("hot", "u", "2024-01-01 00:00:00")] * 3000 + [(f"t{i}", "u", "2024-01-01 00:00:00") for i in range(50)]
    folder = str(tmp_path / "hot")
    spark.createDataFrame(rows, "text string, username string, created_at string").repartition(8).write.json(folder)
    posts = prepare(stream_feed(spark, folder, files_per_trigger=3), NOW).select("post_id", "text", "created_at")
    got, _ = run(
        spark, windows.drop_repeats(windows.with_event_time(posts)).drop("event_time"), tmp_path, "append"
    )
    assert got.count() == 51


def test_stream_to_store_is_idempotent(spark, feed, tmp_path):
    store = PostStore(spark, str(tmp_path / "store")).create()
    write = sinks.imports_to(store, "live", "feed", lambda: NOW)
    for attempt in range(2):  # a lost checkpoint repeats all batches
        sinks.start(
            stream(spark, feed, 2), write, str(tmp_path / f"c{attempt}"), "append", refresh_minutes=None
        ).awaitTermination()
    assert store.imports().count() == 3
    expected = batch(spark, feed)
    assert same(store.topic_posts("live").select(expected.columns), expected)


def test_parquet_feed(spark, feed, tmp_path):
    read_feed(spark, feed).write.parquet(str(tmp_path / "p"))
    assert same(read_feed(spark, str(tmp_path / "p"), "parquet"), read_feed(spark, feed))
    timed = windows.with_event_time(
        prepare(stream_feed(spark, str(tmp_path / "p"), "parquet", None), NOW, row_key="row_key")
    )
    got, _ = run(spark, windows.volume(timed), tmp_path, "update", "window_start", "window_end")
    assert got.agg(F.sum("count")).first()[0] == batch(spark, feed).count()


def test_stream_needs_a_small_lexicon(spark, feed):
    from hearsay.operators.sentiment import classify
    from hearsay.schema import LEXICON_SCHEMA

    lexicon = spark.createDataFrame([("nice", 0.6, 1.0)], LEXICON_SCHEMA)
    assert classify(stream(spark, feed), lexicon).isStreaming
    with pytest.raises(ValueError, match="lexicon"):
        classify(stream(spark, feed), lexicon, literal_rows=0)


def test_refresh_period(spark, feed, tmp_path):
    df = stream(spark, feed).select("post_id")
    with pytest.raises(ValueError):
        sinks.start(df, sinks.batches_to(str(tmp_path / "x")), str(tmp_path / "c"), "append", refresh_minutes=5)
    query = sinks.start(df, sinks.batches_to(str(tmp_path / "x")), str(tmp_path / "c"), "append")
    try:
        assert query.isActive
    finally:
        query.stop()


def test_updated_windows_are_merged(spark, tmp_path):
    """Files follow the keys, not the micro-batches; a repeated batch replaces itself."""
    path = str(tmp_path / "windows")
    write = sinks.batches_to(path, "hour", compact_every=4)
    for batch_id in range(13):
        batch = spark.createDataFrame([(batch_id // 3, batch_id), (99, batch_id)], "hour int, n int")
        write(batch, batch_id)
        if batch_id % 5 == 0:
            write(batch, batch_id)
    got = {r.hour: r.n for r in sinks.latest_rows(spark, path, batch.schema, "hour").collect()}
    assert got == {0: 2, 1: 5, 2: 8, 3: 11, 4: 12, 99: 12}
    assert sinks._log(spark, path).rows().count() <= 5


def test_readers_keep_their_version_during_merges(spark, tmp_path):
    """A reader never fails and never sees less, while every second batch merges."""
    path, seen, errors, done = str(tmp_path / "windows"), [], [], threading.Event()
    schema = StructType.fromDDL("hour int, n int")

    def looks():
        try:
            while not done.is_set():
                seen.append(sinks.latest_rows(spark, path, schema, "hour").agg(F.sum("n")).first()[0] or 0)
        except Exception as e:
            errors.append(e)

    reader = threading.Thread(target=looks)
    reader.start()
    write = sinks.batches_to(path, "hour", compact_every=2)
    held = None
    for batch_id in range(40):
        write(spark.createDataFrame([(batch_id % 3, batch_id)], schema), batch_id)
        if batch_id == 5:
            held = sinks.latest_rows(spark, path, schema, "hour")
    done.set()
    reader.join()
    assert not errors and seen == sorted(seen)
    assert sorted(map(tuple, held.collect())) == [(0, 3), (1, 4), (2, 5)]
    assert sorted(map(tuple, sinks.latest_rows(spark, path, schema, "hour").collect())) == [(0, 39), (1, 37), (2, 38)]


def test_a_broken_merge_changes_nothing(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "windows"), StructType.fromDDL("hour int, n int")
    write = sinks.batches_to(path, "hour", compact_every=4)
    batches = [spark.createDataFrame([(i // 2, i), (9, i)], schema) for i in range(6)]
    for i in range(4):
        write(batches[i], i)
    commit = sinks._commit
    monkeypatch.setattr(sinks, "_commit", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        write(batches[4], 4)
    monkeypatch.setattr(sinks, "_commit", commit)
    assert sorted(map(tuple, sinks.latest_rows(spark, path, schema, "hour").collect())) == [(0, 1), (1, 3), (9, 3)]
    for i in (4, 4, 5):  # the batch is repeated, and once more
        write(batches[i], i)
    assert sorted(map(tuple, sinks.latest_rows(spark, path, schema, "hour").collect())) == [(0, 1), (1, 3), (2, 5), (9, 5)]


def test_long_replaced_folders_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "KEEP_SECONDS", -60)
    path, schema = str(tmp_path / "windows"), StructType.fromDDL("hour int, n int")
    write = sinks.batches_to(path, "hour", compact_every=4)
    for i in range(13):
        write(spark.createDataFrame([(0, i)], schema), i)
    assert len(list((tmp_path / "windows").glob("rows-*"))) + len(list((tmp_path / "windows").glob("merged-*"))) <= 6
    assert [tuple(r) for r in sinks.latest_rows(spark, path, schema, "hour").collect()] == [(0, 12)]
