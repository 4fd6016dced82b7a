from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hearsay.operators import language as l
from hearsay.schema import ENTITY_SCHEMA, STOPWORDS


@pytest.fixture
def texts(spark):
    rows = [("1", "New York and York in new york"), ("2", "the the it's York"), ("3", ""), ("4", None)]
    return spark.createDataFrame(rows, "post_id string, cleaned_text string")


@pytest.fixture
def gazetteer(spark):
    rows = [("new york", "New York", "GPE"), ("York", "York", "GPE"), ("york", "York", "GPE"), ("york", "Duke", "PERSON")]
    return spark.createDataFrame(rows, ENTITY_SCHEMA)


@pytest.mark.parametrize("literal_rows", [5000, 0])
def test_entities(texts, gazetteer, literal_rows):
    matches = l.match_entities(texts, gazetteer, literal_rows=literal_rows)
    expected = {("New York", "GPE"): 2, ("York", "GPE"): 4, ("Duke", "PERSON"): 4}
    as_dict = lambda df: {(r.entity, r.type): r["count"] for r in df.collect()}
    assert as_dict(l.count_entities(matches)) == expected
    assert as_dict(l.entity_counts(texts, gazetteer, literal_rows=literal_rows)) == expected
    assert [r.entity for r in l.top_entities(matches, 2).collect()] == ["Duke", "York"]


def test_entity_plug_in(texts):
    def capitals(batches):
        for pdf in batches:
            found = pdf.dropna().assign(entity=lambda d: d.cleaned_text.str.findall(r"\b[A-Z]\w+"))
            found = found.explode("entity").dropna()
            yield pd.DataFrame({"post_id": found.post_id, "entity": found.entity, "type": "CAP"})

    counts = {r.entity: r["count"] for r in l.count_entities(l.extract_entities(texts, capitals)).collect()}
    assert counts == {"New": 1, "York": 3}


def test_words_with_list_and_table(spark, texts):
    expected = {"new": 2, "york": 4, "it's": 1}
    as_dict = lambda df: {r.word: r["count"] for r in df.collect()}
    assert as_dict(l.word_counts(texts)) == expected
    table = spark.createDataFrame([(w,) for w in STOPWORDS], "word string")
    assert as_dict(l.word_counts(texts, table)) == expected
    assert as_dict(l.word_counts(texts, [])) == {**expected, "the": 2, "and": 1, "in": 1}
    assert [r.word for r in l.word_frequency(texts, k=2).collect()] == ["york", "new"]


def test_word_counts_against_plain_count(spark, sf_dir):
    import re

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = Counter(
        w for r in docs.select("text").collect() for w in re.findall(r"[^\W][\w']+", r.text.lower())
    )
    got = {r.word: r["count"] for r in l.word_counts(docs, [], "text").collect()}
    assert got == dict(expected)


def test_topic_model(spark):
    rows = [(i, ("cat dog cat pet " if i % 2 else "star moon star sky ") * 5) for i in range(40)]
    tokens = l.topic_tokens(spark.createDataFrame(rows, "post_id int, cleaned_text string"))
    model = l.topic_model(tokens, topics=2, iterations=60)
    described = l.describe_topics(model, 3)
    assert described.count() == 6
    terms = {frozenset(r.t) for r in described.groupBy("topic").agg(F.collect_set("term").alias("t")).collect()}
    assert terms == {frozenset({"cat", "dog", "pet"}), frozenset({"star", "moon", "sky"})}
    lines = l.topic_lines(described).collect()
    assert len(lines) == 2 and all(r.line.count("*") == 3 for r in lines)


@pytest.mark.parametrize("literal_rows", [5000, 0])
def test_entities_of_any_length_and_form(spark, literal_rows):
    entries = ["United States of America", "U.S.", "Plan B", "b", "one two three four five six", "?!"]
    rows = [(e, e, "T") for e in entries]
    texts = [
        ("1", "The united states of america, or U.S."), ("2", "Plan B, plan b; B"), ("3", "one two three four five six"),
        ("3", "one two three four five six"), ("4", None), ("5", "united states of"),
    ]
    posts = spark.createDataFrame(texts, "post_id string, cleaned_text string")
    gazetteer = spark.createDataFrame(rows, ENTITY_SCHEMA)
    got = {r.entity: r["count"] for r in l.entity_counts(posts, gazetteer, literal_rows=literal_rows).collect()}
    assert got == {"United States of America": 1, "U.S.": 1, "Plan B": 2, "b": 3, "one two three four five six": 2}
    matches = l.match_entities(posts, gazetteer, literal_rows=literal_rows)
    assert {r.entity: r["count"] for r in l.count_entities(matches).collect()} == got


def test_long_stopword_lists(spark, texts):
    many = [f"w{i}" for i in range(6000)] + ["york"]
    assert {r.word for r in l.word_counts(texts, many).collect()} == {"new", "and", "in", "the", "it's"}


def test_topic_model_uses_every_text_and_term(spark):
    rows = [(i, f"common word{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(300)]
    tokens = l.topic_tokens(spark.createDataFrame(rows, "post_id int, cleaned_text string"))
    counts = l.topic_input(tokens)
    assert counts.count() == 600 and counts.select("term").distinct().count() == 301
    model = l.topic_model(tokens, topics=2, iterations=3)
    assert model.terms.count() == 301 == model.lda.vocabSize()


def test_one_job_per_lookup(spark):
    from hearsay.sources.lookups import small_rows

    df = spark.createDataFrame([("a" * 10,)] * 20, "word string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lookup", "")
    assert len(small_rows(df)) == 20 and small_rows(df, 19) is None
    # one fetch each; its limit may look at a first partition and then at the rest
    assert len(tracker.getJobIdsForGroup("lookup")) <= 4
    assert small_rows(spark.createDataFrame([("a" * 2000,)], "word string")) is None
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def topic_words(spark, rows):
    return spark.createDataFrame([(f"p{i}", words) for i, words in enumerate(rows)], "post_id string, tokens array<string>")


def plain_mixture(counts, weights, concentration):
    k = len(weights[0])
    mixture = [1 / k] * k
    for _ in range(2000):
        new = [concentration - 1] * k
        for n, w in zip(counts, weights):
            total = sum(a * b for a, b in zip(w, mixture))
            for t in range(k):
                new[t] += n * w[t] * mixture[t] / total
        mixture = [x / sum(new) for x in new]
    return mixture


def test_topics_of_texts_by_a_stored_model(spark, tmp_path):
    from hearsay.operators import topics

    fruit, tools = ["apple", "pear", "plum"], ["hammer", "saw", "drill"]
    tokens = topic_words(spark, [fruit * 20 if i % 2 else tools * 20 for i in range(40)])
    counts = topics.TopicCounts.of(l.topic_model(tokens, topics=2, iterations=60))
    total = sum(sum(r.counts) for r in counts.terms.collect())
    assert abs(total - 40 * 60) < 1e-6 and abs(sum(counts.totals) - total) < 1e-6
    counts.save(str(tmp_path / "model"))
    again = topics.TopicCounts.load(spark, str(tmp_path / "model"))
    texts = topic_words(spark, [fruit * 300, tools * 300, fruit * 50 + tools * 50, ["unknown"], fruit[:1]])
    got = {r.post_id: r.mixture for r in topics.topic_mixture(texts, again).collect()}
    assert got == {r.post_id: r.mixture for r in topics.topic_mixture(texts, counts).collect()}
    assert all(abs(sum(m) - 1) < 1e-9 for m in got.values()) and got["p3"] == [0.5, 0.5]
    # the prior counts as much as 24 words of each topic
    main = got["p0"].index(max(got["p0"]))
    assert max(got["p0"]) > 0.9 and got["p1"].index(max(got["p1"])) == 1 - main
    weights = {r.term: r.weights for r in again.weights().collect()}
    want = plain_mixture([50] * 6, [weights[t] for t in fruit + tools], again.mixture)
    assert all(abs(a - b) < 1e-6 for a, b in zip(got["p2"], want))


def test_training_goes_on_with_new_texts(spark):
    from hearsay.operators import topics

    fruit, tools = ["apple", "pear", "plum"], ["hammer", "saw", "drill"]
    tokens = topic_words(spark, [fruit * 20 if i % 2 else tools * 20 for i in range(40)])
    before = topics.TopicCounts.of(l.topic_model(tokens, topics=2, iterations=60))
    new = topic_words(spark, [(fruit + ["cherry"]) * 200, (tools + ["rasp"]) * 200])
    after = topics.continue_topics(new, before)
    assert abs(sum(after.totals) - sum(before.totals) - 1600) < 1e-6
    old, now = ({r.term: r.counts for r in m.terms.collect()} for m in (before, after))
    assert set(now) == set(old) | {"cherry", "rasp"}
    side = lambda c: c.index(max(c))
    assert side(now["cherry"]) == side(old["apple"]) != side(old["saw"]) == side(now["rasp"])


def test_entities_of_many_lengths_and_shared_beginnings(spark):
    """The digests of beginnings find what a plain scan finds, whatever follows a known beginning."""
    import random

    rng, letters = random.Random(8), "a b c d"
    entries = sorted({" ".join(rng.choices(letters.split(), k=rng.randrange(1, 7))) for _ in range(60)})
    texts = [" ".join(rng.choices(letters.split(), k=rng.randrange(0, 25))) for _ in range(40)] + [None, ""]
    posts = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "post_id string, cleaned_text string")
    known = spark.createDataFrame([(e, e.upper(), "X") for e in entries], "ngram string, entity string, type string")
    want = []
    for i, text in enumerate(texts):
        tokens = (text or "").split()
        want += [(str(i), e.upper()) for a in range(len(tokens)) for e in entries if tokens[a : a + len(e.split())] == e.split()]
    for rows in (5000, 0):
        got = l.match_entities(posts, known, literal_rows=rows).select("post_id", "entity")
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_joined_entities_leave_few_candidates(spark):
    """A frequent first token alone makes no sequence; those of other entries that begin alike, and repeated texts, are found."""
    texts = [("1", "the " * 400), ("2", "the end of the long road"), ("2", "the end of the long road"), ("3", "the"), ("4", "the end")]
    posts = spark.createDataFrame(texts, "post_id string, cleaned_text string")
    entries = ["the end of the long road", "the end of a day", "the end", "long", "the the end"]
    known = spark.createDataFrame([(e, e, "T") for e in entries], ENTITY_SCHEMA)
    grams, _ = l._grams(posts, known, "cleaned_text", 0, "post_id")
    want = Counter({"the end of the long road": 2, "the end": 3, "long": 2})
    found = Counter(r.ngram for r in grams.collect())
    assert sum(found.values()) < 12 and not want - found
    assert {r.entity: r["count"] for r in l.entity_counts(posts, known, literal_rows=0).collect()} == want


def test_topic_model_is_the_same_in_blocks_of_any_size(spark, monkeypatch):
    """Expectation-maximisation over many blocks and parts gives what plain loops give from the same start."""
    import numpy as np

    from hearsay.operators import term_blocks, topics

    rng = np.random.default_rng(3)
    rows = [[f"w{i}" for i in rng.integers(0, 30, n)] for n in rng.integers(1, 25, 40)]
    tokens = topic_words(spark, rows)
    pairs = l.topic_input(tokens).select("post_id", "term", "count", F.xxhash64("post_id").alias("p"), F.xxhash64("term").alias("t")).collect()
    spread = np.random.default_rng(42).integers(0, 1 << 63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    p, t = (np.array([r[c] for r in pairs]).view(np.uint64) for c in "pt")
    start = p ^ (t * spread[0])
    start = (start ^ (start >> np.uint64(31)))[:, None] * spread[1:]
    start = (start ^ (start >> np.uint64(29))) >> np.uint64(11)
    shares = {(r.post_id, r.term): s + 0.5 for r, s in zip(pairs, start)}
    for turn in range(4):
        of_text, of_term = Counter(), Counter()
        for r in pairs:
            g = shares[r.post_id, r.term]
            of_text[r.post_id] = of_text[r.post_id] + g / g.sum() * r["count"]
            of_term[r.term] = of_term[r.term] + g / g.sum() * r["count"]
        total = sum(of_term.values())
        for r in pairs:
            shares[r.post_id, r.term] = (of_term[r.term] + 0.1) * (of_text[r.post_id] + 50 / 2) / (total + 0.1 * len(of_term))
    mixtures = []
    for size in (1 << 18, 13):
        monkeypatch.setattr(term_blocks, "BLOCK_TOKENS", size)
        monkeypatch.setattr(term_blocks, "PART_PAIRS", size)
        model = l.topic_model(tokens, topics=2, iterations=3)
        got = {r.term: r.counts for r in model.terms.collect()}
        assert set(got) == set(of_term) and np.allclose([got[t] for t in of_term], [of_term[t] for t in of_term])
        assert np.allclose(model.lda.totals, total)
        mixtures.append({r.post_id: r.mixture for r in topics.topic_mixture(tokens, topics.TopicCounts.of(model)).collect()})
    assert mixtures[0].keys() == mixtures[1].keys() == {f"p{i}" for i in range(40)}
    assert all(np.allclose(mixtures[0][k], mixtures[1][k]) for k in mixtures[0])
