"""Entities, words and topics of the cleaned texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.functions.text import entity_tokens, letter_tokens, slices, words
from hearsay.operators.rankings import top
from hearsay.operators.term_blocks import lists, numbers, term_blocks, term_parts
from hearsay.schema import STOPWORDS
from hearsay.sources.lookups import MAX_LITERAL_ROWS, small_rows
from hearsay.sources.scratch import discard, written

ENTITY_OUTPUT = "post_id string, entity string, type string"
#: Tokens of an entry that make its key in a join.
KEY_TOKENS = 3


def match_entities(
    posts: DataFrame,
    gazetteer: DataFrame,
    text_column: str = "cleaned_text",
    literal_rows: int = MAX_LITERAL_ROWS,
) -> DataFrame:
    """(post_id, entity, type) for every place of the text where a gazetteer entry stands, of any length.

    Entries and texts are compared token by token, so case and punctuation don't matter.
    """
    grams, known = _grams(posts, gazetteer, text_column, literal_rows, "post_id")
    return grams.join(known, "ngram").select("post_id", "entity", "type")


def extract_entities(
    posts: DataFrame, extractor: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
) -> DataFrame:
    """Plug-in point: the extractor maps batches of (post_id, cleaned_text) to entities."""
    return posts.select("post_id", "cleaned_text").mapInPandas(extractor, ENTITY_OUTPUT)


def count_entities(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity", "type").agg(F.count("*").alias("count"))


def top_entities(entities: DataFrame, k: int = 20) -> DataFrame:
    return top(count_entities(entities), "count", "entity", "type", k=k)


def entity_counts(
    posts: DataFrame,
    gazetteer: DataFrame,
    text_column: str = "cleaned_text",
    literal_rows: int = MAX_LITERAL_ROWS,
) -> DataFrame:
    """``count_entities(match_entities(...))`` with sequences counted before the join.

    What is shuffled and joined is one row per distinct sequence, so neither the
    corpus size nor a very frequent one loads a single task.
    """
    grams, known = _grams(posts, gazetteer, text_column, literal_rows)
    counted = grams.groupBy("ngram").agg(F.count("*").alias("n"))
    return counted.join(known, "ngram").groupBy("entity", "type").agg(F.sum("n").alias("count"))


def _grams(
    posts: DataFrame, gazetteer: DataFrame, text_column: str, literal_rows: int, *keep: str
) -> tuple[DataFrame, DataFrame]:
    """Token sequences of the texts that may be gazetteer entries, and the normalised gazetteer.

    The entries of a gazetteer that passes the size check are literals: digests
    of all their beginnings, in one set for each length. From each place of a
    text the digest is extended token by token while it is a known beginning, so
    a step is one hash probe and only whole entries become strings. The
    beginnings of a larger gazetteer's entries are joined.
    """
    known = gazetteer.select(F.array_join(entity_tokens(F.col("ngram")), " ").alias("ngram"), "entity", "type")
    known = known.filter(F.col("ngram") != "").distinct()
    # The tokens are a column of their own: inside the lambdas the expression
    # would be evaluated again for every token.
    tokens = posts.select(*keep, entity_tokens(F.col(text_column)).alias("_tokens"))
    rows = small_rows(known, literal_rows)
    if rows is None:
        return _joined_grams(posts.select(*keep, F.col(text_column).alias("_text")), known, *keep), known
    known = posts.sparkSession.createDataFrame(rows, known.schema)
    begins, whole = _beginnings(known)
    if not begins:
        return tokens.select(*keep, F.lit("").alias("ngram")).limit(0), known
    places = F.transform("_tokens", lambda t, i: F.struct(i.alias("p"), _extended(F.lit(0), t).alias("h")))
    frame = tokens.withColumn("_open", F.filter(places, lambda c: c["h"].isin(begins[0])))
    ended = []
    for n in range(1, len(begins) + 1):
        if n > 1:
            # a place whose text ends here has a null digest, which no set holds
            further = F.transform("_open", lambda c: F.struct(c["p"].alias("p"), _extended(c["h"], F.get("_tokens", c["p"] + n - 1)).alias("h")))
            frame = frame.withColumn("_open", F.filter(further, lambda c: c["h"].isin(begins[n - 1])))
        if whole[n - 1]:
            entry = lambda c: F.array_join(F.slice("_tokens", c["p"] + 1, n), " ")
            frame = frame.withColumn(f"_of{n}", F.transform(F.filter("_open", lambda c: c["h"].isin(whole[n - 1])), entry))
            ended.append(f"_of{n}")
    grams = frame.select(*keep, F.explode(F.concat(*ended)).alias("ngram"))
    return grams, known


def _extended(digest: Column, token: Column) -> Column:
    """Digest of a sequence of tokens, given that of all but the last; null without a token."""
    return F.when(token.isNotNull(), F.xxhash64(digest.cast("bigint"), token))


def _beginnings(known: DataFrame) -> tuple[list[list[int]], list[list[int]]]:
    """For each length, the digests of the entries' beginnings of that many tokens, and of whole entries; a bounded list."""
    entry = F.split("ngram", " ")
    digest = lambda n: F.aggregate(F.slice(entry, 1, n), F.lit(0).cast("bigint"), lambda h, t: F.xxhash64(h, t))
    each = F.explode(F.sequence(F.lit(1), F.size(entry))).alias("n")
    rows = known.select("ngram", each).select("n", (F.col("n") == F.size(entry)).alias("all"), digest(F.col("n")).alias("h")).distinct().collect()
    longest = max((r.n for r in rows), default=0)
    begins, whole = ([[] for _ in range(longest)] for _ in range(2))
    for r in rows:
        begins[r.n - 1].append(r.h)
        if r["all"]:
            whole[r.n - 1].append(r.h)
    return begins, whole


def _joined_grams(texts: DataFrame, known: DataFrame, *keep: str) -> DataFrame:
    """The sequences for a gazetteer of any size: digests of the entries' first tokens meet the texts' in a join.

    An entry has one key, of its first ``KEY_TOKENS`` tokens or of all if it is
    shorter. What comes out of the join is little more than the entries' places.
    Only digests and positions are shuffled there, and nothing while the keys,
    which are written to be of a known size, fit a broadcast; the texts come in
    by their digest when the starts are known.
    """
    entry = F.split("ngram", " ")
    depth = F.least(F.size(entry), F.lit(KEY_TOKENS))
    key = F.aggregate(F.slice(entry, 1, depth), F.lit(0).cast("bigint"), lambda h, t: F.xxhash64(h, t))
    keys = known.select(depth.alias("depth"), key.alias("key"), F.size(entry).alias("n"))
    keys = written(keys.groupBy("depth", "key").agg(F.array_sort(F.collect_set("n")).alias("lengths")), "entity-keys")
    depths = sorted(r.depth for r in keys.select("depth").distinct().collect())  # KEY_TOKENS rows at most
    texts = texts.withColumn("_digest", F.unhex(F.md5("_text")))
    digests = [_extended(F.lit(0), F.col("_first"))]
    for n in range(1, max(depths, default=1)):
        digests.append(_extended(digests[-1], F.col(f"_next{n}")))
    # one place is its token and those after it; all that leaves the task is its digests
    tokens = texts.select("_digest", entity_tokens(F.col("_text")).alias("_tokens"))
    after = [F.concat(F.slice("_tokens", n + 1, F.size("_tokens")), F.array_repeat(F.lit(None).cast("string"), n)) for n in range(1, len(digests))]
    rows = tokens.select("_digest", F.posexplode(F.arrays_zip("_tokens", *after)).alias("p", "_t"))
    rows = rows.select("_digest", "p", *[F.col("_t").getField(str(i) if i else "_tokens").alias(f"_next{i}" if i else "_first") for i in range(len(digests))])
    each = [F.struct(F.lit(d).alias("depth"), digests[d - 1].alias("key")) for d in depths]
    places = rows.select("_digest", "p", F.explode(F.array(*each)).alias("_k")).select("_digest", "p", "_k.*") if each else rows.select("_digest", "p", F.lit(0).alias("depth"), F.lit(0).alias("key")).limit(0)
    starts = places.where(F.col("key").isNotNull()).join(keys, ["depth", "key"]).groupBy("_digest")
    # repeated texts have equal starts
    starts = starts.agg(F.collect_set(F.struct("p", "lengths")).alias("_starts"))
    placed = texts.join(starts, "_digest").select(*keep, entity_tokens(F.col("_text")).alias("_tokens"), "_starts")
    return placed.select(*keep, F.explode(slices(F.col("_tokens"), F.col("_starts"))).alias("ngram"))


def word_counts(
    posts: DataFrame,
    stopwords: Iterable[str] | DataFrame = STOPWORDS,
    text_column: str = "cleaned_text",
) -> DataFrame:
    """Occurrences of every word that is not a stopword.

    A short list of stopwords is tested before counting; a long one and a table
    are anti-joined after it, when each word is one row.
    """
    tokens = posts.select(F.explode(words(F.col(text_column))).alias("word"))
    table = stopwords if isinstance(stopwords, DataFrame) else None
    if table is None:
        listed = list(stopwords)
        if len(listed) > MAX_LITERAL_ROWS:
            table = posts.sparkSession.createDataFrame([(w,) for w in listed], "word string")
        elif listed:
            tokens = tokens.filter(~F.col("word").isin(listed))
    counts = tokens.groupBy("word").agg(F.count("*").alias("count"))
    if table is not None:
        counts = counts.join(table.select("word").distinct(), "word", "left_anti")
    return counts


def word_frequency(
    posts: DataFrame,
    stopwords: Iterable[str] | DataFrame = STOPWORDS,
    k: int = 200,
    text_column: str = "cleaned_text",
) -> DataFrame:
    return top(word_counts(posts, stopwords, text_column), "count", "word", k=k)


def topic_tokens(posts: DataFrame, text_column: str = "cleaned_text", key: str = "post_id") -> DataFrame:
    """(key, tokens) of the texts that hold at least one topic token."""
    return posts.select(key, letter_tokens(F.col(text_column)).alias("tokens")).filter(F.size("tokens") > 0)


def topic_input(tokens: DataFrame, key: str = "post_id") -> DataFrame:
    """(key, term, count) of all texts and all terms: what the topic model is trained on."""
    return tokens.select(key, F.explode("tokens").alias("term")).groupBy(key, "term").agg(F.count("*").alias("count"))


def topic_blocks(tokens: DataFrame, key: str = "post_id") -> DataFrame:
    """The counts of :func:`topic_input` in blocks of texts, as a written table."""
    return term_blocks(tokens, key)


#: The terms' concentration of a model trained by expectation-maximisation, where none is given.
TERM_CONCENTRATION = 1.1


@dataclass
class TopicFit:
    """The topics' totals, the number of terms, and the concentrations of mixtures and terms (as for EM, above 1)."""

    totals: list[float]
    size: int
    mixture: float
    concentration: float

    def vocabSize(self) -> int:
        return self.size


@dataclass
class TopicModel:
    """A fitted model and the table (term, counts) of its terms: how often each stands for each topic."""

    lda: TopicFit
    terms: DataFrame


def topic_totals(terms: DataFrame, topics: int) -> list[float]:
    sums = [F.sum(F.get("counts", F.lit(k))) for k in range(topics)]
    return [n or 0.0 for n in terms.agg(F.array(*sums).alias("n")).first().n]


def term_weights(terms: DataFrame, totals: list[float], size: int, concentration: float) -> DataFrame:
    """(term, weights): the share of each term among a topic's terms, smoothed."""
    more = concentration - 1
    share = lambda n, k: (n + F.lit(more)) / (F.get(F.array(*map(F.lit, totals)), k) + F.lit(more * size))
    return terms.select("term", F.transform("counts", share).alias("weights"))


def added_counts(rows: DataFrame, topics: int) -> DataFrame:
    """(term, counts) summed over blocks of (terms, added)."""
    each = rows.select(F.explode(F.arrays_zip("terms", "added")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.added").alias("added"))
    return each.groupBy("term").agg(F.array(*[F.sum(F.get("added", F.lit(k))) for k in range(topics)]).alias("counts"))


def topic_model(
    tokens: DataFrame, topics: int = 3, seed: int = 42, iterations: int = 20, key: str = "post_id", blocks: DataFrame | None = None
) -> TopicModel:
    """Topics of all texts over all terms, by expectation-maximisation.

    The steps are those of Spark's LDA with its optimizer ``em``: how often each
    term and each text stand for each topic begins at random and gets better by
    turns. Texts are in blocks and terms in parts (:mod:`term_blocks`). In a turn
    each part sums what the blocks add to its terms and sends every block the
    weights of those it holds; then each block fits its texts. No vocabulary
    reaches the driver, and no task holds more than a block or a part. Tables of a
    turn are removed with the next. ``blocks`` are those of the texts, where
    :func:`topic_blocks` has made them before.
    """
    own_blocks = blocks is None
    blocks = topic_blocks(tokens, key) if own_blocks else blocks
    parts = term_parts(blocks)
    size = parts.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first().n
    mixture, more = 50 / topics + 1, TERM_CONCENTRATION - 1
    spread = np.random.default_rng(seed).integers(0, 1 << 63, topics + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def fitted(ways: pa.Table, own: pa.Table) -> pa.Table:
        ends, at, n = (numbers(own, c).astype(kind) for c, kind in (("ends", int), ("at", int), ("n", float)))
        places = [np.array(p) for p in ways["places"].to_numpy()]
        if "weights" in ways.column_names:
            weights = np.empty((topics, sum(map(len, places))))
            for p, w in zip(places, ways["weights"].to_numpy()):
                weights[:, p] = np.array(w).reshape(topics, -1)
            mine = numbers(own, "mine").reshape(topics, -1) + (mixture - 1)
            shares = weights[:, at] * np.repeat(mine, np.diff(ends, prepend=0), axis=1)
        else:
            of_text, of_term = (numbers(own, c).astype(np.int64).view(np.uint64) for c in ("key_hashes", "term_hashes"))
            hashes = np.repeat(of_text, np.diff(ends, prepend=0)) ^ (of_term[at] * spread[0])
            hashes = (hashes ^ (hashes >> np.uint64(31))) * spread[1:, None]
            shares = ((hashes ^ (hashes >> np.uint64(29))) >> np.uint64(11)) + 0.5
        shares *= n / shares.sum(axis=0)
        mine = np.add.reduceat(shares, np.append(0, ends[:-1]), axis=1)
        sums = np.stack([np.bincount(at, weights=s) for s in shares])
        added = [*(sums[:, p].ravel() for p in places), shares.sum(axis=1)]
        many = lambda rows: pa.array(rows, pa.list_(pa.float64()))
        block = pa.array(own["block"][:1].to_pylist() * len(added), pa.int32())
        part = pa.array([*ways["part"].to_pylist(), None], pa.int32())
        return pa.table({"block": block, "part": part, "added": many(added), "mine": many([None] * len(places) + [mine.ravel()])})

    def summed(given: pa.Table, ways: pa.Table) -> tuple[np.ndarray, pa.Table, dict[int, np.ndarray]]:
        of_blocks = ways.filter(pc.is_valid(ways["block"]))
        at = {b: np.array(a) for b, a in zip(of_blocks["block"].to_pylist(), of_blocks["at"].to_numpy())}
        counts = np.zeros((topics, len(ways.filter(pc.is_null(ways["block"]))["terms"][0])))
        given = given.sort_by("block")
        for b, added in zip(given["block"].to_pylist(), given["added"].to_numpy()):
            counts[:, at[b]] += np.array(added).reshape(topics, -1)
        return counts, of_blocks, at

    def sender(totals: list[float]) -> Callable[[pa.Table, pa.Table], pa.Table]:
        smoothed = np.array(totals)[:, None] + more * size

        def sent(given: pa.Table, ways: pa.Table) -> pa.Table:
            counts, of_blocks, at = summed(given, ways)
            weights = (counts + more) / smoothed
            each = pa.array([weights[:, at[b]].ravel() for b in of_blocks["block"].to_pylist()], pa.list_(pa.float64()))
            return of_blocks.select(["block", "part", "places"]).append_column("weights", each)

        return sent

    def listed(given: pa.Table, ways: pa.Table) -> pa.Table:
        terms = ways.filter(pc.is_null(ways["block"]))["terms"].combine_chunks().flatten()
        return pa.table({"term": terms, "counts": lists(summed(given, ways)[0].T)})

    def turn(ways: DataFrame, *columns: Column, state: DataFrame | None = None) -> DataFrame:
        own = blocks.select("block", "ends", "at", "n", *columns)
        own = own.unionByName(state, allowMissingColumns=True) if state is not None else own
        both = ways.groupBy("block").cogroup(own.toDF(*own.columns).groupBy("block"))
        return written(both.applyInArrow(fitted, "block int, part int, added array<double>, mine array<double>"), "topic-step")

    def at_parts(run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        given = step.where("part is not null").select("block", "part", "added")
        return given.groupBy("part").cogroup(parts.groupBy("part")).applyInArrow(run, schema)

    def totals() -> list[float]:
        sums = [F.coalesce(F.sum(F.get("added", F.lit(k))), F.lit(0.0)) for k in range(topics)]
        return step.where("part is null").agg(F.array(*sums).alias("n")).first().n

    hashes = [F.transform(c, lambda x: F.xxhash64(x)).alias(name) for c, name in (("keys", "key_hashes"), ("terms", "term_hashes"))]
    step = turn(parts.where("block is not null").select("block", "part", "places"), *hashes)
    for _ in range(iterations):
        ways = at_parts(sender(totals()), "block int, part int, places array<int>, weights array<double>")
        new = turn(ways, state=step.where("mine is not null").select("block", "mine"))
        discard(step)
        step = new
    terms = written(at_parts(listed, "term string, counts array<double>"), "topic-counts")
    fit = TopicFit(totals(), size, mixture, 1 + more)
    discard(step, parts, *([blocks] if own_blocks else []))
    return TopicModel(fit, terms)


def describe_topics(model: TopicModel, terms: int = 10) -> DataFrame:
    """(topic, rank, term, weight) of the heaviest terms of each topic."""
    total = F.get(F.array(*map(F.lit, model.lda.totals)), F.col("topic"))
    each = model.terms.select("term", F.posexplode("counts").alias("topic", "n")).select("topic", "term", (F.col("n") / total).alias("weight"))
    order = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    heaviest = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= terms)
    return heaviest.select("topic", "rank", "term", "weight")


def topic_lines(described: DataFrame) -> DataFrame:
    """One line per topic, as in ``0.012*"word" + 0.010*"other"``."""
    term = F.format_string('%.3f*"%s"', F.col("weight"), F.col("term"))
    lines = described.groupBy("topic").agg(
        F.array_sort(F.collect_list(F.struct("rank", term.alias("term")))).alias("terms")
    )
    return lines.select("topic", F.array_join(F.col("terms.term"), " + ").alias("line"))
