"""Every registered query with SQL gives the same rows as that SQL."""

import pytest

from checks.compare import connect, difference
from checks.oracle import ORACLE_SQL
from checks.queries import QUERIES


#: Length and digest: disaster, happy and sad words, platforms, missing-value strings, headers.
PINNED = [
    (26, "0e93a221"),
    (26, "6b8dc356"),
    (19, "f3920b12"),
    (7, "cf32e277"),
    (19, "a977a59f"),
    (23, "56393a2c"),
]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_same_rows(spark, con, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name]) is None


def test_only_the_topic_model_lacks_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"topic_model"}


def test_entry(spark):
    import __spark_entry__ as entry

    rows = {r.topic: (r.crisis_score, r.alert) for r in entry.entry(spark).collect()}
    assert rows == {
        "all": (50.0, "Moderate"),
        "mixed": (62.5, "High"),
        "links": (100.0, "Extreme"),
        "plain": (0.0, "Normal"),
    }
    assert set(entry.queries()) >= set(entry.oracle_sql())


def test_fixed_lists_are_pinned():
    """The SQL takes these lists from the library, so their content is pinned here."""
    import hashlib

    from hearsay import schema

    digest = lambda values: (len(values), hashlib.md5("\n".join(sorted(values)).encode()).hexdigest()[:8])
    headers = [f"{k}:{h}" for k, hs in schema.HEADER_ALIASES.items() for h in hs]
    lists = (schema.DISASTER_WORDS, schema.HAPPY_WORDS, schema.SAD_WORDS, schema.PLATFORMS, schema.NA_STRINGS, headers)
    assert [digest(x) for x in lists] == PINNED
