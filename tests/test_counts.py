"""Counts against plain Python over the same rows, and their invariants."""

from collections import Counter, defaultdict

import pytest

from hearsay.operators import crisis as c
from hearsay.operators import distributions as d
from hearsay.operators import rankings as r


@pytest.fixture(scope="module")
def rows(posts):
    return posts.collect()


def pairs(df, key, value="count"):
    return {row[key]: row[value] for row in df.collect()}


def ranked(counter, k):
    return sorted(counter.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_distributions(posts, rows):
    for df, key in ((d.sentiment_counts(posts), "sentiment"), (d.platform_distribution(posts), "platform")):
        assert pairs(df, key) == Counter(x[key] for x in rows)
        shares = pairs(df, key, "share")
        assert sum(shares.values()) == pytest.approx(1.0)
    volume = pairs(d.hourly_volume(posts), "hour")
    assert volume == Counter(x.created_at.replace(minute=0, second=0, microsecond=0) for x in rows)
    assert sum(volume.values()) == len(rows)


def test_key_metrics(posts, rows):
    m = d.key_metrics(posts).first()
    assert m.total_posts == len(rows)
    assert m.positive_posts == sum(x.sentiment == "Positive" for x in rows)
    assert m.avg_retweets == round(sum(x.retweet_count for x in rows) / len(rows), 1)
    assert m.platforms == len({x.platform for x in rows})
    assert d.key_metrics(posts, approximate=True).first().platforms == m.platforms
    empty = d.key_metrics(posts.filter("false")).first()
    assert (empty.total_posts, empty.positive_posts, empty.avg_retweets, empty.platforms) == (0, 0, None, 0)


def test_mean_is_rounded_half_even(spark):
    for values, expected in (([0, 0, 0, 1], 0.2), ([2] * 11 + [3] * 9, 2.4), ([0, 1, 1, 1], 0.8)):
        df = spark.createDataFrame([(v, "x", "y") for v in values], "retweet_count long, sentiment string, platform string")
        assert d.key_metrics(df).first().avg_retweets == expected


def test_metric_rows_and_back(posts):
    counts = d.count_by(posts, "sentiment")
    metrics = d.sentiment_metrics(counts)
    assert all(x.metric.startswith("sentiment_") and isinstance(x.value, str) for x in metrics.collect())
    other = metrics.sparkSession.createDataFrame([("reach", "5")], metrics.schema)
    assert pairs(d.read_sentiment_metrics(metrics.union(other)), "sentiment") == pairs(counts, "sentiment")


def test_rankings(posts, rows):
    tags = Counter(t for x in rows for t in x.hashtags)
    assert [(x.hashtag, x["count"]) for x in r.top_hashtags(posts).collect()] == ranked(tags, 10)
    users, retweets, followers = Counter(), Counter(), defaultdict(int)
    for x in rows:
        users[x.username] += 1
        retweets[x.username] += x.retweet_count
        followers[x.username] = max(followers[x.username], x.user_followers)
    assert [tuple(x) for x in r.top_users(posts).collect()] == [(u, n, retweets[u]) for u, n in ranked(users, 10)]
    assert [tuple(x) for x in r.top_influencers(posts, 5).collect()] == ranked(followers, 5)


def test_engagement(posts, rows):
    assert r.engagement_points(posts).count() == len(rows)
    bins = r.engagement_bins(posts).collect()
    assert sum(x["count"] for x in bins) == sum(x.retweet_count > 0 and x.like_count > 0 for x in rows)
    assert all(x.retweet_bin >= 0 and x.like_bin >= 0 for x in bins)


def test_crisis(posts, rows):
    one = c.crisis(posts).first()
    assert one.total_posts == len(rows) and 0 <= one.crisis_score <= 100
    assert one.disaster_posts == sum(x.sentiment == "Disaster" for x in rows)
    none = c.crisis(posts.filter("false")).first()
    assert (none.crisis_score, none.alert) == (0.0, "Normal")
    per = c.crisis(posts, "platform").collect()
    assert sum(x.total_posts for x in per) == len(rows)


def test_disaster_sample(posts, rows):
    sample = c.disaster_sample(posts, 7).collect()
    first = sorted((x for x in rows if x.sentiment == "Disaster"), key=lambda x: (x.created_at, x.post_id))[:7]
    assert [tuple(x) for x in sample] == [(x.text, x.sentiment, x.platform) for x in first]


@pytest.mark.parametrize(
    "query", ["top_hashtags", "top_users", "top_influencers", "disaster_sample", "word_frequency", "entity_counts"]
)
def test_top_k_is_no_full_sort(spark, sf_dir, query):
    from checks.queries import QUERIES

    plan = QUERIES[query](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange rangepartitioning" not in plan


@pytest.mark.parametrize("query", ["place_breakdown", "top_place"])
def test_top_k_per_level_is_limited_before_the_shuffle(spark, sf_dir, query):
    from checks.queries import QUERIES

    plan = QUERIES[query](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("query", ["sentiment_counts", "platform_distribution", "stored_sentiment"])
def test_shares_need_no_single_partition_window(spark, sf_dir, query):
    from checks.queries import QUERIES

    plan = QUERIES[query](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_no_python_and_no_cross_join_in_any_query(spark, sf_dir):
    from checks.queries import QUERIES

    for name, query in QUERIES.items():
        if name.startswith(("stream", "topic_model", "csv", "entity_plug_in")):
            continue
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        for word in ("EvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert word not in plan, (name, word)
