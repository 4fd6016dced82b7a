import csv
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hearsay.operators import ingest
from hearsay.plans.imports import prepare
from hearsay.schema import HEADER_ALIASES, POST_COLUMNS, POST_SCHEMA
from hearsay.sources.csv import _lines, file_forms, malformed_lines, read_posts_csv, write_posts_csv

from support import NOW


def frame(spark, **columns):
    names = list(columns)
    return spark.createDataFrame(
        list(zip(*columns.values())), ", ".join(f"`{n}` string" for n in names)
    )


@pytest.mark.parametrize("target", list(HEADER_ALIASES))
def test_every_header_is_renamed(spark, target):
    for header in HEADER_ALIASES[target]:
        assert ingest.alias_columns(frame(spark, **{header: ["x"], "other": ["y"]})).columns == [target, "other"]


def test_header_names_are_case_sensitive(spark):
    assert ingest.alias_columns(frame(spark, tweet=["x"])).columns == ["tweet"]


def test_two_headers_for_one_target(spark):
    df = frame(spark, Text=["x", "y"], Likes=["1", None], Favorites=["2", "3"])
    with pytest.raises(ValueError, match="like_count"):
        ingest.alias_columns(df)
    merged = ingest.alias_columns(df, on_collision="coalesce")
    assert sorted(merged.columns) == ["like_count", "text"]
    assert [r.like_count for r in merged.orderBy("text").collect()] == ["1", "3"]


def test_text_is_required(spark):
    with pytest.raises(ValueError, match="text"):
        ingest.normalise(frame(spark, User=["x"]), NOW)


def test_defaults(spark):
    row = ingest.normalise(frame(spark, Tweet=["hello"]), NOW).first()
    assert (row.created_at, row.retweet_count, row.like_count, row.user_followers) == (NOW, 0, 0, 0)
    assert (row.username, row.location, row.platform, row.hashtags) == ("unknown", None, "Unknown", "")


def test_null_username_becomes_unknown(spark):
    df = spark.createDataFrame([("x", None)], "text string, User string")
    assert ingest.normalise(df, NOW).first().username == "unknown"


def test_topic_filter(spark):
    df = frame(spark, text=["Big Fire", "fire.works", None, "water"])
    found = lambda *a, **k: sorted(r.text for r in ingest.filter_topic(df, *a, **k).collect())
    assert found("FIRE") == ["Big Fire", "fire.works"]
    assert found("fire.w") == ["fire.works"]
    assert found("f.re") == ["Big Fire", "fire.works"]
    assert found("f.re", literal=True) == []
    assert found("e.W", literal=True) == ["fire.works"]


def test_filter_sees_every_text_header(spark):
    posts = prepare(frame(spark, **{"Tweet-Text": ["a fire", "b"]}), NOW, "fire")
    assert [r.text for r in posts.collect()] == ["a fire"]


def test_post_ids(spark):
    df = frame(spark, text=["a", "a", "b"], User=["u", "u", "u"], idx=["1", "2", "3"])
    by_row = {r.post_id for r in ingest.normalise(df, NOW, "idx").collect()}
    by_content = [r.post_id for r in ingest.normalise(df, NOW).collect()]
    again = [r.post_id for r in ingest.normalise(df, dt.datetime(2030, 1, 1)).collect()]
    assert len(by_row) == 3 and len(set(by_content)) == 2 and by_content == again


def test_enriched_schema_and_record(make_posts):
    posts = make_posts(
        dict(text="RT @a Help #Me", created_at="2024-03-02 05:06:07", location="P, S, C", platform="reddit", hashtags="['x']")
    )
    assert [(f.name, f.dataType) for f in posts.schema] == [(f.name, f.dataType) for f in POST_SCHEMA]
    r = posts.first()
    assert (r.cleaned_text, r.sentiment, r.city, r.state, r.country) == ("Help Me", "Disaster", "P", "S", "C")
    assert (r.year, r.month, r.day, r.hour, r.hashtags) == (2024, 3, 2, 5, ["x", "Me"])


def test_enrich_keeps_every_row(make_posts):
    rows = [dict(text=t) for t in ("", "a", "a", "#x #y", "https://x")]
    assert make_posts(*rows).count() == 5


def test_enrich_has_no_shuffle_and_no_python(posts, spark, sf_dir):
    from checks import queries

    plan = queries.posts(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert posts.columns == POST_COLUMNS


def test_columns_are_pruned_to_the_scan(spark, sf_dir):
    from checks import queries
    from hearsay.operators.distributions import platform_distribution

    plan = platform_distribution(queries.posts(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint>" in plan and "emergency" not in plan


def test_csv_round_trip(spark, tmp_path):
    texts = ['say "hi", all', "two\nlines", " padded ", "comma, here", "#tag 日本", "back\\slash"]
    df = frame(spark, Text=texts, Likes=["1", "NA", "n/a", "", "None", "2"])
    write_posts_csv(df.repartition(2), str(tmp_path / "csv"))
    back = {r.Text: r.Likes for r in read_posts_csv(spark, str(tmp_path / "csv")).collect()}
    assert back == dict(zip(texts, ["1", None, None, None, None, "2"]))


def test_csv_file_as_exported(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text(
        "Tweet,Timestamp,User,Retweets,Platform,Extra\n"
        '"Fire, ""big"" one\nnext line #A",2024-01-02 03:04:05,ann,3.0,twitter,z\n'
        "calm,nan,,x, Threads ,\n",
        encoding="utf-8",
    )
    rows = prepare(read_posts_csv(spark, str(path)), NOW).orderBy("created_at").collect()
    assert [r.text for r in rows] == ['Fire, "big" one\nnext line #A', "calm"]
    assert [r.sentiment for r in rows] == ["Disaster", "Neutral"]
    assert [(r.retweet_count, r.platform, r.username) for r in rows] == [(3, "Twitter", "ann"), (0, "Threads", "unknown")]
    assert rows[1].created_at == NOW


def test_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Text,User,Likes\nhello one,ann,3\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text('Author,Likes,Tweet\nbob,7,"hello\nthree"\n', encoding="utf-8")
    (tmp_path / "c.csv").write_text("", encoding="utf-8")
    rows = read_posts_csv(spark, str(tmp_path))
    with pytest.raises(ValueError, match="text"):
        ingest.normalise(rows, NOW)
    got = ingest.normalise(rows, NOW, on_collision="coalesce").orderBy("like_count").collect()
    assert [(r.text, r.username, r.like_count) for r in got] == [("hello one", "ann", 3), ("hello\nthree", "bob", 7)]


def test_form_of_each_file_is_found(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Text,Likes\n"a, ""b""",1\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text('Text,Likes\n"a\nb",1\n', encoding="utf-8")
    forms = file_forms(spark, str(tmp_path))
    assert [(names, multiline, len(files)) for names, multiline, files in forms] == [
        (["Text", "Likes"], False, 1), (["Text", "Likes"], True, 1),
    ]


@pytest.mark.parametrize("name", ["a b.csv", "c[1].csv", "50%.csv", "d%20e.csv", "{x}*?.csv", "日本.csv"])
def test_any_file_name(spark, tmp_path, name):
    (tmp_path / name).write_text('Text,Likes\n"one\ntwo",1\n', encoding="utf-8")
    for path in (str(tmp_path), str(tmp_path / name)):
        assert [tuple(r) for r in read_posts_csv(spark, path).collect()] == [("one\ntwo", "1")]
    (tmp_path / name).write_text("Text,Likes\nplain,1\n", encoding="utf-8")
    assert [tuple(r) for r in read_posts_csv(spark, str(tmp_path / name)).collect()] == [("plain", "1")]


def test_repeated_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Text,User,User,U`s.r,user\nhi,ann,bob,x,carl\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("user,Text,User.1\ndora,ho,eve\n", encoding="utf-8")
    rows = read_posts_csv(spark, str(tmp_path))
    assert rows.columns == ["Text", "User", "User.1", "U`s.r", "user"]
    assert sorted(map(tuple, rows.collect()), key=str) == [
        ("hi", "ann", "bob", "x", "carl"), ("ho", None, "eve", None, "dora"),
    ]
    assert sorted(r.username for r in prepare(rows, NOW).select("username").collect()) == ["ann", "unknown"]
    (tmp_path / "c.csv").write_text("Text,text,User\n,low,fay\nhigh,other,gus\n", encoding="utf-8")
    rows = read_posts_csv(spark, str(tmp_path / "c.csv"))
    with pytest.raises(ValueError, match="text"):
        ingest.normalise(rows, NOW)
    got = ingest.normalise(rows, NOW, on_collision="coalesce").collect()
    assert {r.username: r.text for r in got} in ({"fay": "low", "gus": "high"}, {"fay": "low", "gus": "other"})


def test_line_breaks_are_split_over_tasks(spark, tmp_path):
    """A file of many byte ranges, with records and quotes across their ends, gives the rows that one task reads."""
    rng = random.Random(4)
    pieces = ["plain", "two\nlines", 'say "hi"', ', comma, "', "\n", "\n\n\n", '"', "x" * 3000, "", 'end"', '5" pipe', "é\r\nß"]
    rows = [("".join(rng.choices(pieces, k=rng.randrange(1, 5))), str(i)) for i in range(800)]
    path = tmp_path / "big.csv"
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(["Text", "Likes"])
        for text, i in rows:
            out.writerow([f"t{text}", i])
        f.write('odd 5" pipe,800\n7"" two,801\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = read_posts_csv(spark, str(path))
        assert _lines(spark, [str(path)]).rdd.getNumPartitions() > 50
        found = sorted((int(r.Likes), r.Text) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(str(path))
    assert found == sorted((int(r.Likes), r.Text) for r in whole.collect())
    assert len(found) == 802 and found[:800] == [(int(i), f"t{t}") for t, i in rows]


@pytest.mark.parametrize("text", ['Text,Likes\r\n"a\r\nb",1\r\n\r\nc,2\r\n', 'Text,Likes\n\n"a\n\nb",1\nc,2', '\ufeffText,Likes\n"",1\n"x\n",2\n'])
def test_line_ends_and_blank_lines(spark, tmp_path, text):
    (tmp_path / "a.csv").write_bytes(text.encode())
    whole = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(str(tmp_path / "a.csv"))
    assert sorted(map(tuple, read_posts_csv(spark, str(tmp_path)).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_malformed_lines_are_reported(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Text,Likes\nfine,1\nsurplus,1,2,3\nshort\n", encoding="utf-8")
    assert sorted(r.line for r in malformed_lines(spark, str(tmp_path)).collect()) == ["short", "surplus,1,2,3"]
    assert read_posts_csv(spark, str(tmp_path)).count() == 3


def test_single_line_csv_is_split(spark, tmp_path):
    write_posts_csv(frame(spark, Text=["a", "b"]).coalesce(1), str(tmp_path / "csv"))
    assert read_posts_csv(spark, str(tmp_path / "csv"), multiline=False).count() == 2


def test_search(make_posts):
    from hearsay.operators.search import posts_search

    posts = make_posts(
        dict(text="Fire #a", created_at="2024-01-01 10:00:00"),
        dict(text="fire #b", created_at="2024-01-02 10:00:00"),
        dict(text="x #a", created_at="2024-01-03 10:00:00"),
    )
    texts = lambda **k: sorted(r.text for r in posts_search(posts, **k).collect())
    assert texts() == ["Fire #a", "fire #b", "x #a"]
    assert texts(keyword="FIRE") == ["Fire #a", "fire #b"]
    assert texts(hashtag="a") == ["Fire #a", "x #a"]
    assert texts(start="2024-01-02 10:00:00") == ["fire #b", "x #a"]
    assert texts(end="2024-01-02 10:00:00", keyword="fire", hashtag="b") == ["fire #b"]
    assert texts(keyword="f.*#", literal=True) == []
    assert posts.filter(F.lit(True)).count() == 3
