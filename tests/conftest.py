import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

from hearsay.session import session  # noqa: E402
from support import NOW  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    spark = session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions=4,
        spark__driver__memory="4g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def posts(spark, sf_dir):
    """All derived posts, enriched, cached for the whole run."""
    from checks import queries

    return queries.posts(spark, sf_dir, places=True).cache()


@pytest.fixture
def one(spark):
    """Evaluate a column builder on a list of strings."""

    def run(values, build):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
        rows = df.select("i", build(F.col("s")).alias("out")).orderBy("i").collect()
        return [r.out for r in rows]

    return run


@pytest.fixture
def make_posts(spark):
    """Enriched posts from short tuples; missing fields get plain values."""

    def build(*rows, lexicon=None, ingest_ts=NOW):
        from hearsay.operators.ingest import enrich, normalise

        names = ["idx", "text", "created_at", "username", "location", "platform", "hashtags", "retweet_count"]
        filled = [
            tuple(str({"idx": i, **r}[n]) if {"idx": i, **r}.get(n) is not None else None for n in names)
            for i, r in enumerate(rows)
        ]
        raw = spark.createDataFrame(filled, ", ".join(f"{n} string" for n in names))
        return enrich(normalise(raw, ingest_ts, "idx"), lexicon)

    return build
