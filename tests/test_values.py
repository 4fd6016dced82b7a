import datetime as dt

from pyspark.sql import functions as F

from hearsay.functions import values as v
from hearsay.functions.alerts import alert_state, crisis_score
from hearsay.schema import NA_STRINGS


def test_counts(one):
    cases = {
        "3.7": 3, "-3.7": -3, "1,000": 0, "x": 0, "1e3": 1000, " 5 ": 5, "1d": 0, "1f": 0, "": 0, "+7": 7,
        "inf": 0, "NaN": 0, ".5": 0, "5.": 5, "9007199254740993": 9007199254740993, "1e30": 0, "0x10": 0,
    }
    assert one(cases, v.to_count) == list(cases.values())
    assert one([None], v.to_count) == [0]


def test_times(one):
    now = dt.datetime(2000, 1, 1)
    cases = {
        "2024-01-05T10:11:12Z": dt.datetime(2024, 1, 5, 10, 11, 12),
        "2024-01-05 10:11": dt.datetime(2024, 1, 5, 10, 11),
        "2024-01-05 10:11:12.25": dt.datetime(2024, 1, 5, 10, 11, 12, 250000),
        "2024-01-05": dt.datetime(2024, 1, 5),
        "1/5/2024 3:04": dt.datetime(2024, 1, 5, 3, 4),
        "13/01/2024": dt.datetime(2024, 1, 13),
        "13-01-2024 10:00:00": dt.datetime(2024, 1, 13, 10),
        "Mon Jan 01 10:00:00 +0530 2024": dt.datetime(2024, 1, 1, 10),
        "5 Jan 2024": dt.datetime(2024, 1, 5),
        "Jan 5, 2024": dt.datetime(2024, 1, 5),
        "1/5/2024 3:04 PM": dt.datetime(2024, 1, 5, 15, 4),
        "12/5/2024 12:04 am": dt.datetime(2024, 12, 5, 0, 4),
        "January 5, 2024": dt.datetime(2024, 1, 5),
        "Fri, 05 Jan 2024 10:00:00 GMT": dt.datetime(2024, 1, 5, 10),
        "05-Jan-2024": dt.datetime(2024, 1, 5),
        "Jan 5 2024 10:00AM": dt.datetime(2024, 1, 5, 10),
        "2024/01/05 10:00:00.123": dt.datetime(2024, 1, 5, 10, 0, 0, 123000),
        "05.01.2024": dt.datetime(2024, 5, 1),
        "31.01.2024": dt.datetime(2024, 1, 31),
        "20240105": dt.datetime(2024, 1, 5),
        "2024-01-05 10:00 UTC": dt.datetime(2024, 1, 5, 10),
        "1/5/24": dt.datetime(2024, 1, 5),
        "1/5/70": dt.datetime(1970, 1, 5),
        "2024-01-05T10:11:12+05:30": dt.datetime(2024, 1, 5, 10, 11, 12),
        "5th March 2024, 7:08 p.m.": dt.datetime(2024, 3, 5, 19, 8),
        "20240105T101112": dt.datetime(2024, 1, 5, 10, 11, 12),
        "20240105101112": dt.datetime(2024, 1, 5, 10, 11, 12),
        "Jan 2024": dt.datetime(2024, 1, 1),
        "5/2024": dt.datetime(2024, 5, 1),
        "5 January 2024 at 10:00": dt.datetime(2024, 1, 5, 10),
        "January 5th, 2024 3 PM": dt.datetime(2024, 1, 5, 15),
        "10:00 5 January 2024": dt.datetime(2024, 1, 5, 10),
        "2024-01-05 10:11:12,250": dt.datetime(2024, 1, 5, 10, 11, 12, 250000),
        "Sept. 5, 2024": dt.datetime(2024, 9, 5),
        "13:00 PM": now,
        "3 PM": now,
        "January": now,
        "5 Foo 2024": now,
        "1/2/3/2024": now,
        "on 1/5/2024": now,
        "not a date": now,
        "31/31/2024": now,
        "": now,
        " ": now,
    }
    assert one(cases, lambda c: v.to_time(c, F.lit(str(now)))) == list(cases.values())
    assert one([None], lambda c: v.to_time(c, F.lit(str(now)))) == [now]


def test_platforms(one):
    cases = {
        "twitter": "Twitter", "Bluesky ": "Bluesky", "MASTODON": "Mastodon", "unknown": "Unknown",
        "nan": "Unknown", "None": "Unknown", "": "Unknown", " ": "Unknown", "Threads ": "Threads", "NaN": "NaN",
    }
    assert one(cases, v.canonical_platform) == list(cases.values())
    assert one([None], v.canonical_platform) == ["Unknown"]


def test_missing_strings(one):
    assert one(NA_STRINGS, v.null_if_missing) == [None] * len(NA_STRINGS)
    assert one(["na", " ", "0"], v.null_if_missing) == ["na", " ", "0"]


def test_log_bins(one):
    got = one(["0", "1", "9", "10", "999", "1000", "-5"], lambda c: v.log_bin(c.cast("long")))
    assert got == [None, 0, 0, 1, 2, 3, None]


def test_crisis_score_and_alert(spark):
    rows = [(0, 0), (1, 10), (1, 40), (0, 5), (626, 10000), (560, 10000), (256, 10000), (750, 10000)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d long, t long")
    score = crisis_score(F.col("d"), F.col("t"))
    got = [tuple(r)[1:] for r in df.select("i", score, alert_state(score)).orderBy("i").collect()]
    assert got[:4] == [(0.0, "Normal"), (100.0, "Extreme"), (25.0, "Normal"), (0.0, "Normal")]
    assert [a for _, a in got[4:]] == ["High", "High", "Moderate", "High"]


def test_unreadable_times_are_counted(spark):
    from hearsay.operators.ingest import unreadable_times

    df = spark.createDataFrame([("x", "1/5/24"), ("x", "soon"), ("x", " "), ("x", None)], "Text string, Date string")
    assert tuple(unreadable_times(df).first()) == (1, 4)


def test_numbers_are_extracted_once(spark):
    df = spark.createDataFrame([("1",)], "s string").select(v.to_count(F.col("s")).alias("n"))
    plan = df.filter("n > 0").groupBy(v.log_bin(F.col("n"))).count()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") <= 2
