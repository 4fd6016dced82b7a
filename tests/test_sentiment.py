import pytest
from pyspark.sql import functions as F

from hearsay.functions import sentiment as s
from hearsay.operators.sentiment import add_polarity, classify, join_polarity
from hearsay.schema import DISASTER_WORDS, HAPPY_WORDS, LEXICON_SCHEMA, SAD_WORDS

LEXICON = [
    ("nice", 0.6, 1.0), ("bad", -0.7, 0.6), ("edge", 0.1, 0.2), ("low", -0.1, 0.2), ("odd", 0.15, 0.2),
    ("nice", 0.5, 1.0), ("gone", None, 0.1), (None, 0.9, 0.9),
]

CASES = {
    "FIRE and joy": "Disaster",
    "helpful": "Disaster",
    "window": "Happy",
    "unhappy": "Happy",
    "so sorry": "Sad",
    "great loss": "Happy",
    "nice": "Positive",
    "bad day": "Negative",
    "edge": "Neutral",
    "low": "Neutral",
    "odd": "Positive",
    "nice bad": "Neutral",
    "nothing here": "Neutral",
    "": "Neutral",
    "gone": "Neutral",
}


@pytest.fixture
def lexicon(spark):
    return spark.createDataFrame(LEXICON, LEXICON_SCHEMA)


@pytest.mark.parametrize("literal_rows", [5000, 0])
def test_classes_with_literal_and_joined_lexicon(spark, lexicon, literal_rows):
    rows = [(str(i), text) for i, text in enumerate([*CASES, None])]
    df = spark.createDataFrame(rows, "post_id string, cleaned_text string")
    got = {r.cleaned_text: r.sentiment for r in classify(df, lexicon, literal_rows=literal_rows).collect()}
    assert got == {**CASES, None: "Neutral"}


def test_without_lexicon_only_keywords_decide(spark):
    df = spark.createDataFrame([("1", "nice"), ("2", "fire")], "post_id string, cleaned_text string")
    assert {r.post_id: r.sentiment for r in classify(df).collect()} == {"1": "Neutral", "2": "Disaster"}


def test_whole_word_mode(spark):
    df = spark.createDataFrame(
        [("1", "helpful window"), ("2", "help!"), ("3", "unhappy"), ("4", "a win.")],
        "post_id string, cleaned_text string",
    )
    got = {r.post_id: r.sentiment for r in classify(df, match="word").collect()}
    assert got == {"1": "Neutral", "2": "Disaster", "3": "Sad", "4": "Happy"}


def test_every_keyword_decides(one):
    for name, words in (("Disaster", DISASTER_WORDS), ("Happy", HAPPY_WORDS), ("Sad", SAD_WORDS)):
        got = one(words, lambda c: s.keyword_class(c))
        # 'unhappy' contains 'happy', which is tested first
        assert [w for w, g in zip(words, got) if g != name] == [w for w in words if name == "Sad" and w == "unhappy"]


def test_word_counts_of_the_lists():
    assert [len(set(w)) for w in (DISASTER_WORDS, HAPPY_WORDS, SAD_WORDS)] == [26, 26, 19]


def test_polarity_paths_agree(spark, lexicon):
    texts = ["nice nice bad", "bad odd low edge", "x", "", None, "nice " * 1000 + "bad"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    a = {r.id: r.polarity for r in add_polarity(df, lexicon, "s").collect()}
    b = {r.id: r.polarity for r in join_polarity(df, lexicon, "s").collect()}
    assert a == b
    assert a[0] == pytest.approx((0.6 + 0.6 - 0.7) / 3) and a[2] is None and a[4] is None


def test_filter_on_class_stays_small(spark, posts):
    """A pushed-down filter must not multiply the keyword tests."""
    from checks import queries

    fresh = queries.posts(spark, "/root/testdata/sf0.001").filter(F.col("sentiment") == "Disaster")
    plan = fresh._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("emergency") <= 4


def test_pattern_finds_exactly_the_terms(one):
    import random

    words = [*DISASTER_WORDS, *HAPPY_WORDS, *SAD_WORDS]
    rng = random.Random(7)
    texts = ["x" + w + "y" for w in words] + [w[:-1] for w in words] + [w[1:] for w in words]
    texts += ["".join(rng.choice("abcdefghilmnoprstuvwy ") for _ in range(40)) for _ in range(3000)]
    texts += [a[: rng.randrange(1, len(a))] + b for a in words for b in rng.sample(words, 5)]
    got = one(texts, lambda c: s.keyword_class(c))
    for text, found in zip(texts, got):
        expected = next(
            (
                name
                for name, terms in (("Disaster", DISASTER_WORDS), ("Happy", HAPPY_WORDS), ("Sad", SAD_WORDS))
                if any(t in text for t in terms)
            ),
            None,
        )
        assert found == expected, text


def test_decided_rows_cross_no_exchange(spark, sf_dir):
    """By a lexicon join, only rows without a keyword are shuffled."""
    from checks import derived, queries
    from hearsay.operators.sentiment import classify

    df = queries.clean_text(spark, sf_dir)
    plan = classify(df, derived.lexicon(spark), literal_rows=0)._jdf.queryExecution().executedPlan().toString()
    union = plan[plan.index("Union") :]
    first = union[: union.index("Join")]
    decided = first[: first.rindex("FileScan") + 1] if first.count("FileScan") else first
    assert "Exchange" not in decided
