from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearsay.functions import text as t


def test_clean_text_cases(one):
    cases = {
        "RT @ann: look #here https://x.y/z now": ": look here  now",
        "START now": "STAnow",
        "a@b.com": "a.com",
        "   \tx　 ": "x",
        "#a ##b": "a b",
        "R#T x": "x",
        "a  b": "a  b",
        "http://x": "",
        "ftp://x": "ftp://x",
        "": "",
    }
    assert one(cases, t.clean_text) == list(cases.values())
    assert one([None], t.clean_text) == [""]


def test_strip_knows_all_white_space(one):
    assert all(c.isspace() for c in t.WHITESPACE)
    every = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    assert set(t.WHITESPACE) == set(every)
    assert one([c + "x y" + c for c in every], t.strip) == ["x y"] * len(every)


def test_hashtags_are_unicode_words(one):
    assert one(["#é_1 #日本 #a-b ##c", "none", None, "a#b#c"], t.extract_hashtags) == [
        ["é_1", "日本", "a", "c"],
        [],
        [],
        ["b", "c"],
    ]


def test_hashtag_bag(spark):
    rows = [
        ("['a','#b']", "#t"),
        ('["a", "b"]', ""),
        ("[bad, #q]", "#q"),
        ("[]", "#t"),
        ("[None]", "x"),
        ("#x #y", "#x"),
        ("", None),
        (None, "#only"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h string, s string")
    bag = lambda **kw: [
        r[0]
        for r in df.orderBy("i").select(t.hashtag_bag(F.col("h"), F.col("s"), **kw)).collect()
    ]
    assert bag() == [["a", "#b", "t"], ["a", "b"], ["q", "q"], ["t"], [], ["x", "y", "x"], [], ["only"]]
    assert bag(strip_hash=True)[0] == ["a", "b", "t"]


def test_tag_lists_are_never_evaluated(one):
    assert one(["[__import__('os').getpid()]"], lambda c: t.hashtag_bag(c, F.lit(""))) == [[]]


def test_words_and_letter_tokens(one):
    assert one(["Don't a I2 été--x1 '"], t.words) == [["don't", "i2", "été", "x1"]]
    assert one(["Ab1cd _x a supercalifragilistic ÉTÉ"], t.letter_tokens) == [["ab", "cd", "été"]]


def test_slices(spark):
    rows = [(["a", "b", "c"], [(0, [1, 3]), (1, [2, 3])]), (["a"], [(0, [1, 2])]), ([], [])]
    df = spark.createDataFrame(rows, "w array<string>, s array<struct<p: int, lengths: array<int>>>")
    got = [r[0] for r in df.select(t.slices(F.col("w"), F.col("s"))).collect()]
    assert got == [["a", "a b c", "b c"], ["a"], []]


def test_entity_tokens(one):
    assert one(["U.S. Plan B, don't"], t.entity_tokens) == [["u", "s", "plan", "b", "don't"]]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="RT@#aé_ \t :/hps.1", max_size=30), min_size=1, max_size=40))
def test_cleaned_text_properties(one, texts):
    for cleaned in one(texts, t.clean_text):
        assert "#" not in cleaned and cleaned == cleaned.strip()
    for tags in one(texts, t.extract_hashtags):
        assert all(tag and all(c.isalnum() or c == "_" for c in tag) for tag in tags)
