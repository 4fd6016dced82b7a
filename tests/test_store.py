import concurrent.futures
import datetime as dt
import os
import threading

import pytest
from pyspark.sql import functions as F

from hearsay.plans.imports import import_csv
from hearsay.plans.report import topic_report
from hearsay.sources.log import EVERY
from hearsay.sources.store import REGISTRY, PostStore
from hearsay.sources.store import _hash as hashed

from support import NOW

HOUR = dt.timedelta(hours=1)


@pytest.fixture
def store(spark, tmp_path):
    return PostStore(spark, str(tmp_path / "store")).create()


@pytest.fixture
def few(make_posts):
    return make_posts(
        dict(text="fire #a", platform="twitter"), dict(text="nice fire #a #b"), dict(text="joy #b", location="US")
    )


def test_empty_store(store):
    assert store.search_history().count() == 0
    assert store.topic_posts("x").count() == 0
    assert not store.has_topic("x")
    assert topic_report(store, "x") is None


def test_import_and_read_back(store, few):
    import_id = store.write_import(few, "Fire", NOW)
    back = store.topic_posts("fIRE")
    assert back.count() == 3 and set(few.columns) <= set(back.columns)
    assert {r.import_id for r in back.collect()} == {import_id}
    same = lambda df: sorted(map(str, df.select(few.columns).collect()))
    assert same(back) == same(few)
    assert [(r.hashtag, r["count"]) for r in store.topic_hashtags("fire").collect()] == [("a", 2), ("b", 2)]
    assert {r.sentiment: r["count"] for r in store.topic_sentiment("fire").collect()} == {"Disaster": 2, "Happy": 1}
    assert store.import_summary().first().n_posts == 3


def test_exact_topic_reads(store, few):
    store.write_import(few, "Fire", NOW)
    assert store.topic_posts("fire", exact=True).count() == 0
    assert store.topic_posts("Fire", exact=True).count() == 3
    assert store.has_topic("fire") and not store.has_topic("fire", exact=True)


def test_imports_of_a_topic_add_up(store, few):
    store.write_import(few, "Fire", NOW)
    store.write_import(few, "fire", NOW + 5 * HOUR)
    assert store.searches().count() == 1
    assert store.topic_posts("FIRE").count() == 6
    assert [r["count"] for r in store.topic_hashtags("fire").collect()] == [4, 4]
    assert [(r.hashtag, r["count"]) for r in store.topic_hashtags("fire", parity=True).collect()] == [
        ("a", 2), ("a", 2), ("b", 2), ("b", 2),
    ]
    assert store.searches().first().searched_at == NOW


def test_recent_search_is_exact_and_timed(store, few):
    ids = [
        store.write_import(few, topic, NOW + hours * HOUR, recent=HOUR)
        for topic, hours in (("t", 0), ("t", 0.5), ("T", 0.6), ("t", 1.5))
    ]
    search = {r.import_id: r.search_id for r in store.imports().collect()}
    assert [search[i] for i in ids] == [ids[0], ids[0], ids[2], ids[3]]
    assert store.topic_posts("t", latest=True, exact=True).count() == 3
    assert store.topic_posts("t").count() == 12


def test_search_history_order_and_limit(store, make_posts):
    posts = make_posts(dict(text="x")).cache()
    for i in range(12):
        store.write_import(posts, f"topic{i}", NOW + i * HOUR)
    assert [r.topic for r in store.search_history().collect()] == [f"topic{i}" for i in range(11, 1, -1)]


def test_import_without_posts_leaves_nothing(store, few):
    assert store.write_import(few.filter("text = 'none'"), "Fire", NOW) is None
    assert store.search_history().count() == 0 and not store.has_topic("fire")


def test_leftovers_of_a_failed_import_are_not_counted(store, few, monkeypatch):
    monkeypatch.setattr(store, "find_search", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.write_import(few, "Fire", NOW, import_id="x")
    monkeypatch.undo()
    assert store.write_import(few.filter("text = 'none'"), "Fire", NOW, import_id="x") is None
    assert store.topic_posts("fire").count() == 0
    store.write_import(few.filter("text = 'joy #b'"), "Fire", NOW, import_id="x")
    assert store.import_summary().first().n_posts == store.topic_posts("fire").count() == 1


def test_failed_import_stays_invisible(store, few, monkeypatch):
    """Posts are written, then the import fails before its row."""
    monkeypatch.setattr(store, "find_search", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.write_import(few, "Fire", NOW, import_id="bad")
    assert store._read("posts").count() == 3
    assert store.topic_posts("fire").count() == 0
    assert store.topic_hashtags("fire").count() == 0
    monkeypatch.undo()
    store.write_import(few, "Fire", NOW, import_id="bad")
    assert store.topic_posts("fire").count() == 3


def test_repeated_import_id_replaces(store, few):
    for _ in range(2):
        store.write_import(few, "Fire", NOW, import_id="same")
    assert store.topic_posts("fire").count() == 3 and store.imports().count() == 1
    assert store.import_summary().first().n_posts == 3


def test_odd_topics(store, few):
    topics = ["#tag/x=1", "日本 % {a}", "2024", "a:b*?"]
    for t in topics:
        store.write_import(few, t, NOW)
    for t in topics:
        assert store.topic_posts(t).count() == 3
    assert store.topic_posts("other").count() == 0
    with pytest.raises(ValueError):
        store.write_import(few, "  ", NOW)
    with pytest.raises(ValueError):
        store.write_import(few, "x", NOW, import_id="a/b")


def test_positive_posts_of_first_import(store, make_posts, spark):
    from hearsay.operators.distributions import positive_posts_of_first_import
    from hearsay.schema import LEXICON_SCHEMA

    lexicon = spark.createDataFrame([("nice", 0.6, 1.0)], LEXICON_SCHEMA)
    for hours, texts in ((2, ["nice"] * 5), (1, ["nice", "nice", "x"]), (0, ["x"])):
        store.write_import(make_posts(*[dict(text=t) for t in texts], lexicon=lexicon), "t", NOW + hours * HOUR)
    assert positive_posts_of_first_import(store.topic_sentiment_imports("t")).first()[0] == 2
    assert positive_posts_of_first_import(store.topic_sentiment_imports("none")).first()[0] == 0


def test_topic_read_prunes_partitions(store, few):
    store.write_import(few, "Fire", NOW)
    store.write_import(few, "Other", NOW)
    files = store.topic_posts("fire").inputFiles()
    assert len({f.split("topic_hash=")[1][:32] for f in files if "topic_hash=" in f}) == 1
    plan = store.topic_posts("fire", latest=True).select("platform")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "cleaned_text" not in plan


def test_csv_import(store, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("Text,Likes\nFire one,1\nwater,2\nfire two,x\n")
    assert import_csv(store, str(path), "fire", NOW) is not None
    assert sorted(r.text for r in store.topic_posts("fire").collect()) == ["Fire one", "fire two"]
    assert import_csv(store, str(path), "absent", NOW) is None


def test_report_has_all_panels(store, few, spark):
    from hearsay.schema import ENTITY_SCHEMA, GAZETTEER_SCHEMA

    store.write_import(few, "Fire", NOW)
    report = topic_report(
        store,
        "fire",
        gazetteer=spark.createDataFrame([("country", "US", 1.0, 2.0)], GAZETTEER_SCHEMA),
        entities=spark.createDataFrame([("fire", "Fire", "EVENT")], ENTITY_SCHEMA),
    )
    sizes = {name: df.count() for name, df in report.items()}
    assert len(sizes) == 19 and [name for name, n in sizes.items() if n == 0] == ["engagement"]
    metrics = report["key_metrics"].first()
    assert (metrics.total_posts, metrics.platforms) == (3, 2)
    assert report["entities"].first()["count"] == 2
    assert report["map_centre"].first() == (1.0, 2.0)
    assert report["crisis"].select(F.col("alert")).first()[0] == "Extreme"


def test_repeating_an_import_replaces_everything(store, make_posts):
    """The second try has no tags, the third no posts, the fourth posts again."""
    tags = lambda: [r.hashtag for r in store.topic_hashtags("t").collect()]
    store.write_import(make_posts(dict(text="hi #old")), "t", NOW, import_id="x")
    assert tags() == ["old"]
    store.write_import(make_posts(dict(text="hi new")), "t", NOW, import_id="x")
    assert tags() == [] and [r.text for r in store.topic_posts("t").collect()] == ["hi new"]
    assert store.write_import(make_posts(dict(text="gone")).limit(0), "t", NOW, import_id="x") is None
    assert store.topic_posts("t").count() == 0 and not store.has_topic("t")
    store.write_import(make_posts(dict(text="back #b")), "t", NOW, import_id="x")
    assert tags() == ["b"] and store.imports().count() == 1
    assert store.vacuum() > 0
    assert tags() == ["b"] and store._read("posts").count() == 1


def registry_row(i, topic, at=NOW, n_posts=1):
    values = (f"i{i}", "s", topic, topic.lower(), at.isoformat(), "csv", "multiple", n_posts, hashed(topic), f"{at.isoformat()}")
    return dict(zip(REGISTRY.fieldNames(), values))


def test_registry_files_follow_data_not_imports(store):
    for i in range(200):
        topic = f"topic {i % 3}"
        row = registry_row(i % 150, topic, NOW + i * HOUR, i + 1)
        store._register(lambda _: [row], topic)
    rows = store.imports_with_attempts()
    assert rows.count() == 150 and len(rows.inputFiles()) <= 3 * EVERY
    newest = {r.import_id: r.n_posts for r in rows.collect()}
    assert newest == {f"i{i}": (i + 151 if i < 50 else i + 1) for i in range(150)}


def same_bucket(n):
    """Topics whose registry rows lie in one log."""
    found = (t for t in (f"topic {i}" for i in range(1000)) if hashed(t)[0] == "7")
    return [next(found) for _ in range(n)]


def test_concurrent_imports_are_all_there(store, make_posts):
    """Four threads, topics of one bucket; a reader that looks meanwhile never fails and never sees less."""
    posts = make_posts(dict(text="hi #a"), dict(text="fire")).cache()
    topics, done, seen, errors = same_bucket(4), threading.Event(), [], []

    def imports(topic):
        try:
            for i in range(6):
                assert store.write_import(posts, topic, NOW + i * HOUR) is not None
        except Exception as e:
            errors.append(e)

    def looks():
        try:
            while not done.is_set():
                seen.append(store.imports().count())
                store.topic_posts(topics[0]).count()
        except Exception as e:
            errors.append(e)

    reader = threading.Thread(target=looks)
    writers = [threading.Thread(target=imports, args=(t,)) for t in topics]
    for t in (reader, *writers):
        t.start()
    for t in writers:
        t.join()
    done.set()
    reader.join()
    assert not errors and seen == sorted(seen)
    assert store.imports().count() == 24
    assert {r.topic: r.n_posts for r in store.searches().collect()} == {t: 12 for t in topics}
    assert [store.topic_posts(t).count() for t in topics] == [12] * 4


def test_concurrent_imports_of_a_topic_join_one_search(store, make_posts):
    """Whoever commits second sees the search that the first began."""
    posts = make_posts(dict(text="hi")).cache()
    with concurrent.futures.ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: store.write_import(posts, "t", NOW + i * HOUR), range(4)))
    assert store.searches().count() == 1 and store.topic_posts("t", latest=True).count() == 4


def test_a_lost_race_decides_again(store):
    """Another commit comes between the look and the entry."""
    log, calls = store._log("t"), []

    def decide(rows):
        calls.append(rows.count())
        if len(calls) == 1:
            store._register(lambda _: [registry_row(1, "t")], "t")
        return [registry_row(2, "t")]

    assert log.commit(decide) == 2 and calls == [0, 1]
    assert store.imports().count() == 2


def test_readers_keep_their_state(store, spark):
    log = store._log("t")
    for i in range(3):
        log.commit(lambda _: [registry_row(i, "t")])
    before = log.rows()
    for i in range(3, 20):
        log.commit(lambda _: [registry_row(i, "t")])
    assert before.count() == 3 and log.rows().count() == 20 and log.snapshot().files() <= EVERY


def test_covered_entries_are_deleted_when_old(store, monkeypatch):
    from hearsay.sources import files, log as log_module

    log = store._log("t")
    for i in range(5 * EVERY):
        log.commit(lambda _: [registry_row(i, "t")])
    assert len([n for n, _ in files.listing(store.spark, log.folder) if n.endswith("0.json")]) == 4
    monkeypatch.setattr(log_module, "KEEP_SECONDS", -60)
    log._clean()
    assert len(files.listing(store.spark, log.folder)) <= 2 * EVERY + 4
    assert log.rows().count() == 5 * EVERY


def test_broken_checkpoint_is_passed_over(store, tmp_path):
    log = store._log("t")
    for i in range(2 * EVERY):
        log.commit(lambda _: [registry_row(i, "t")])
    last = log.snapshot().checkpoint
    os.remove(f"{log.folder}/{last}/_SUCCESS")
    assert log.snapshot().checkpoint != last and log.rows().count() == 2 * EVERY


def test_first_import_without_positive_posts_is_passed_over(store, make_posts, spark):
    from hearsay.operators.distributions import positive_posts_of_first_import

    lexicon = spark.createDataFrame([("nice", 0.6, 1.0)], "word string, polarity double, subjectivity double")
    store.write_import(make_posts(dict(text="plain")), "t", NOW, import_id="a")
    store.write_import(make_posts(dict(text="nice"), dict(text="nice one"), lexicon=lexicon), "t", NOW + HOUR, import_id="b")
    assert positive_posts_of_first_import(store.topic_sentiment_imports("t")).first()[0] == 2


def rows_scanned(df, table):
    """Rows that the scans of a store table gave when ``df`` was computed."""
    df.collect()

    def leaves(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            yield from leaves(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            yield from leaves(plan.plan())
        elif plan.children().isEmpty():
            yield plan
        else:
            for i in range(plan.children().size()):
                yield from leaves(plan.children().apply(i))

    found = [p for p in leaves(df._jdf.queryExecution().executedPlan()) if p.getClass().getSimpleName() == "FileSourceScanExec"]
    found = [p for p in found if f"/{table}" in p.relation().location().rootPaths().mkString()]
    return sum(p.metrics().apply("numOutputRows").value() for p in found)


@pytest.fixture
def many_posts(spark):
    """Posts in no order of time, written in small row groups."""
    conf, key = spark.sparkContext._jsc.hadoopConfiguration(), "parquet.block.size"
    conf.set(key, "65536")
    from hearsay.operators.ingest import enrich, normalise

    raw = spark.range(20000).select(
        F.concat(F.lit("post "), "id", F.lit(" #t"), F.col("id") % 7).alias("text"),
        F.timestamp_seconds(1704067200 + (F.col("id") * 7919) % 20000 * 60).cast("string").alias("created_at"),
        F.element_at(F.array(*map(F.lit, ("twitter", "reddit", "mastodon"))), (F.col("id") % 3 + 1).cast("int")).alias("platform"),
    )
    yield enrich(normalise(raw, NOW)).coalesce(1)
    conf.unset(key)


def test_searches_leave_out_row_groups(store, many_posts):
    store.write_import(many_posts, "post", NOW)
    found = store.search("post", start="2024-01-03 00:00:00", end="2024-01-03 06:00:00")
    assert found.count() == 361 and 361 <= rows_scanned(found, "posts") < 4000
    assert rows_scanned(store.search("post"), "posts") == 20000
    assert rows_scanned(store.search("post", platform="Nowhere"), "posts") == 0


def test_searches_by_tag_open_only_imports_that_used_it(store, many_posts):
    store.write_import(many_posts.limit(3000), "post", NOW, import_id="a")
    other = many_posts.withColumn("hashtags", F.array(F.lit("rare")))
    store.write_import(other.limit(500), "post", NOW + HOUR, import_id="b")
    rare, absent = store.search("post", hashtag="rare"), store.search("post", hashtag="absent")
    assert rare.count() == 500 and rows_scanned(rare, "posts") == 500
    assert absent.count() == 0 and rows_scanned(absent, "posts") == 0
    assert store.search("post", hashtag="t1", keyword="post 1").count() == many_posts.limit(3000).filter(
        "array_contains(hashtags, 't1') and text like '%post 1%'"
    ).count()
