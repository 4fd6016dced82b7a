from pyspark.sql import functions as F

from hearsay.functions.places import parse_location, place_label, place_parts
from hearsay.operators import geography as g
from hearsay.schema import COUNTRY_ALIAS_SCHEMA, GAZETTEER_SCHEMA


def test_parse_location(spark):
    cases = {
        "Paris, Ile, France": ("Paris", "Ile", "France"),
        "Paris , France": ("Paris", None, "France"),
        "France": (None, None, "France"),
        " France ": (None, None, "France"),
        "a, b, c, d": (None, None, "a, b, c, d"),
        "Paris,": ("Paris", None, None),
        ", TX, USA": (None, "TX", "USA"),
        ",": (None, None, None),
        " ": (None, None, None),
        "": (None, None, None),
    }
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*cases, None])], "i int, s string")
    split = df.withColumn("p", place_parts(F.col("s")))
    rows = split.select("i", *[c.alias(n) for n, c in parse_location(F.col("s"), F.col("p")).items()])
    got = [tuple(r)[1:] for r in rows.orderBy("i").collect()]
    assert got == [*cases.values(), (None, None, None)]


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def places(spark, *rows):
    return spark.createDataFrame(list(rows), "city string, state string, country string")


def test_finest_level(spark):
    df = places(
        spark,
        ("nan", "TX", "US"),
        ("None", None, "US"),
        (None, None, "nan"),
        (None, None, None),
        ("C", None, "US"),
        ("C", "S", "US"),
    )
    got = sorted([tuple(r) for r in g.located(df).collect()], key=str)
    assert got == sorted(
        [
            ("state", "TX", "TX", "US"),
            ("country", "US", None, "US"),
            ("city", "C", None, "US"),
            ("city", "C", "S", "US"),
        ],
        key=str,
    )


def test_place_counts_and_parity(spark):
    df = places(spark, ("c", "S", "C"), ("c", None, "C"), (None, None, "C"))
    assert g.place_counts(df).count() == 3
    assert rows_of(g.place_counts(df, parity=True), "level", "name", "count") == [("city", "c", 1)]


def test_labels(spark):
    df = spark.createDataFrame(
        [("city", "A", "B", "C", 2), ("city", "A", None, "C", 1), ("state", "B", "B", "C", 3), ("country", "C", None, "C", 4)],
        "level string, name string, state string, country string, n long",
    )
    label = place_label(*[F.col(c) for c in ("level", "name", "state", "country", "n")])
    assert [r[0] for r in df.select(label).collect()] == [
        "A, B, C (2 posts)",
        "A, C (1 posts)",
        "B, C (3 posts)",
        "C (4 posts)",
    ]


def test_heat_points_and_centre(spark):
    counts = g.place_counts(
        places(spark, ("c", "S", "C"), ("c", "S", "C"), (None, None, "USA"), (None, None, "Nowhere"))
    )
    gazetteer = spark.createDataFrame(
        [("city", "c", 10.0, 20.0), ("country", "United States", 30.0, 40.0), ("state", "USA", 1.0, 1.0)],
        GAZETTEER_SCHEMA,
    )
    aliases = spark.createDataFrame([("USA", "United States")], COUNTRY_ALIAS_SCHEMA)
    points = g.heat_points(counts, gazetteer, aliases)
    assert rows_of(points, "name", "lat", "lon", "weight") == [("USA", 30.0, 40.0, 1), ("c", 10.0, 20.0, 2)]
    assert g.map_centre(points).first() == (20.0, 30.0)
    assert g.map_centre(points.filter("lat > 99")).first() == (20.0, 0.0)
    assert rows_of(g.heat_points(counts, gazetteer), "name") == [("c",)]


def test_rollup_totals(posts):
    for column in ("platform", "sentiment"):
        rows = g.by_country(posts, column).collect()
        total = sum(r["count"] for r in rows if r.depth == 2)
        assert [r["count"] for r in rows if r.depth == 0] == [total]
        by_country = {r.country: r["count"] for r in rows if r.depth == 1}
        for country, n in by_country.items():
            assert n == sum(r["count"] for r in rows if r.depth == 2 and r.country == country)
        assert by_country == {r.country: r["count"] for r in g.country_counts(posts).collect()}


def test_breakdown_against_plain_count(posts):
    from collections import Counter

    rows = posts.select("city", "state", "country").collect()
    for level in ("city", "state", "country"):
        counts = Counter(r[level] for r in rows if r[level])
        expected = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:10]
        got = g.place_breakdown(posts).filter(F.col("level") == level).orderBy("rank").collect()
        assert [(r.name, r["count"]) for r in got] == expected
        assert g.top_place(posts).filter(F.col("level") == level).first().name == expected[0][0]
    assert [r.country for r in g.top_countries(posts, 2).collect()] == [c for c, _ in expected[:2]]
