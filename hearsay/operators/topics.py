"""Topics of single texts by a stored model, and training that goes on with new texts.

A model is a table (term, counts): how often each term stands for each topic,
over all texts it has seen. It comes from a fitted LDA, is kept as Parquet, and
meets texts in joins, so no vocabulary reaches the driver; only one number per
topic does. Texts are in blocks, each one group: its terms with their weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.operators.language import TopicModel, added_counts, term_weights, topic_blocks, topic_totals
from hearsay.operators.term_blocks import lists, numbers, on_blocks, sums_by
from hearsay.sources.scratch import discard, written

#: A text's mixture is refined until no share moves by more, or so often.
TOLERANCE, ROUNDS = 1e-9, 200
#: Texts are fitted together while they have about so many terms.
FITTED_PAIRS = 1 << 13


@dataclass
class TopicCounts:
    """Terms (term, counts), the topics' totals, and the concentrations of mixtures and terms (as for EM, above 1)."""

    terms: DataFrame
    totals: list[float]
    mixture: float
    concentration: float

    @classmethod
    def of(cls, model: TopicModel) -> "TopicCounts":
        """The counts of a fitted model."""
        return cls(model.terms, model.lda.totals, model.lda.mixture, model.lda.concentration)

    def save(self, path: str) -> None:
        """Write the terms, and in the same way the few numbers; not over another model."""
        spark = self.terms.sparkSession
        self.terms.write.parquet(f"{path}/terms")
        numbers = [([float(t) for t in self.totals], float(self.mixture), float(self.concentration))]
        spark.createDataFrame(numbers, "totals array<double>, mixture double, concentration double").write.parquet(f"{path}/numbers")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TopicCounts":
        numbers = spark.read.parquet(f"{path}/numbers").first()
        terms = spark.read.schema("term string, counts array<double>").parquet(f"{path}/terms")
        return cls(terms, list(numbers.totals), numbers.mixture, numbers.concentration)

    def weights(self) -> DataFrame:
        """(term, weights): the share of each term among a topic's terms, smoothed."""
        return term_weights(self.terms, self.totals, self.terms.count(), self.concentration)


def _fitted(n: np.ndarray, weights: np.ndarray, ends: np.ndarray, concentration: float) -> tuple[np.ndarray, np.ndarray]:
    """(mixtures, shares) of the topics (rows) in texts, and how often each of their terms stands for each topic.

    From term counts and weights (topics, terms), text by text, each of which
    has a term. A text that moves no more is left as it is.
    """
    topics, lengths = len(weights), np.diff(ends, prepend=0)
    mixtures, shares_of = np.full((topics, len(ends)), 1 / topics), np.zeros(weights.shape)
    left, pairs, now = np.arange(len(ends)), np.arange(len(n)), mixtures.copy()
    for turn in range(ROUNDS):
        shares = weights * np.repeat(now, lengths, axis=1)
        shares *= n / shares.sum(axis=0)
        new = np.add.reduceat(shares, np.cumsum(lengths) - lengths, axis=1) + concentration - 1
        new /= new.sum(axis=0)
        done, now = np.abs(new - now).max(axis=0) < TOLERANCE, new
        if turn == ROUNDS - 1:
            done[:] = True
        if done.any():
            ended, more = np.repeat(done, lengths), ~done
            mixtures[:, left[done]], shares_of[:, pairs[ended]] = now[:, done], shares[:, ended]
            left, pairs, now, lengths = left[more], pairs[~ended], now[:, more], lengths[more]
            n, weights = n[~ended], weights[:, ~ended]
        if not len(left):
            break
    return mixtures, shares_of


def _each(known: pa.Table, own: pa.Table, topics: int, concentration: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, their mixtures, places of terms, their shares) of a block's texts that have a known term; places are rows of ``known``."""
    ends, at, n = (numbers(own, c).astype(kind) for c, kind in (("ends", int), ("at", int), ("n", float)))
    row = np.full(max(at.max(initial=0), known["i"].to_numpy().max(initial=0)) + 1, -1)
    row[known["i"].to_numpy()] = np.arange(len(known))
    at, text = row[at], np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    at, n, text = at[at >= 0], n[at >= 0], text[at >= 0]
    weights = np.ascontiguousarray(numbers(known, "weights").reshape(-1, topics).T)
    first = np.flatnonzero(np.diff(text, prepend=-1))  # of each text
    bounds, begin = np.append(first, len(text)), 0
    while begin < len(first):
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + FITTED_PAIRS, side="right")) - 1)
        some = slice(bounds[begin], bounds[end])
        mixtures, shares = _fitted(n[some], weights[:, at[some]], bounds[begin + 1 : end + 1] - bounds[begin], concentration)
        yield text[first[begin:end]], mixtures, at[some], shares
        begin = end


def topic_mixture(tokens: DataFrame, model: TopicCounts, key: str = "post_id", blocks: DataFrame | None = None) -> DataFrame:
    """(key, mixture): the share of each topic in each text of (key, tokens); even shares without a known term.

    ``blocks`` are those of the texts, where :func:`language.topic_blocks` has made them before.
    """
    concentration, topics = model.mixture, len(model.totals)
    kind = tokens.schema[key].dataType.simpleString()

    def run(known: pa.Table, own: pa.Table) -> pa.Table:
        found = [(text, mixtures.T) for text, mixtures, _, _ in _each(known, own, topics, concentration)]
        at = np.concatenate([text for text, _ in found] or [np.zeros(0, int)])
        keys = pa.concat_arrays([c.flatten() for c in own["keys"].chunks]) if len(at) else pa.nulls(0, own["keys"].type.value_type)
        return pa.table([keys.take(pa.array(at)), lists(np.concatenate([m for _, m in found] or [np.zeros((0, topics))]))], names=[key, "mixture"])

    blocks = topic_blocks(tokens, key) if blocks is None else blocks
    known = on_blocks(blocks, model.weights(), run, f"`{key}` {kind}, mixture array<double>", "keys", "ends", "at", "n")
    even = F.array(*[F.lit(1 / topics)] * topics)
    return tokens.select(key).distinct().join(known, key, "left").select(key, F.coalesce("mixture", even).alias("mixture"))


def continue_topics(tokens: DataFrame, model: TopicCounts, key: str = "post_id", steps: int = 3) -> TopicCounts:
    """The model after it has also seen new texts: their terms' counts are added to those it has.

    New terms begin with even weights. Each step fits the new texts by the model
    with the counts of the step before.
    """
    topics = len(model.totals)
    blocks = topic_blocks(tokens, key)
    fresh = blocks.select(F.explode("terms").alias("term")).distinct().join(model.terms, "term", "left_anti")
    none = F.array_repeat(F.lit(0.0), topics)
    old = written(model.terms.unionByName(fresh.select("term", none.alias("counts"))), "topic-counts")
    now = TopicCounts(old, model.totals, model.mixture, model.concentration)
    concentration = model.mixture

    def run(known: pa.Table, own: pa.Table) -> pa.Table:
        found = [(at, shares) for _, _, at, shares in _each(known, own, topics, concentration)]
        at, shares = (np.concatenate(x, axis=-1) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros((topics, 0)))
        one = lambda items: pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)
        terms = pa.concat_arrays(known["term"].chunks) if len(known) else pa.array([], pa.string())
        return pa.table({"terms": one(terms), "added": one(sums_by(at, shares, len(terms)))})

    for _ in range(steps):
        each = on_blocks(blocks, now.weights(), run, "terms array<string>, added array<array<double>>", "ends", "at", "n")
        added = added_counts(each, topics).withColumnRenamed("counts", "added")
        both = old.join(added, "term", "left")
        grown = F.when(F.col("added").isNull(), F.col("counts")).otherwise(F.zip_with("counts", "added", lambda a, b: a + b))
        terms = written(both.select("term", grown.alias("counts")), "topic-counts")
        now = TopicCounts(terms, topic_totals(terms, topics), model.mixture, model.concentration)
    discard(blocks)
    return now
