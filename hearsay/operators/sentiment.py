"""Sentiment classes and lexicon polarity of a DataFrame of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.functions import sentiment as s
from hearsay.functions.binding import let
from hearsay.functions.text import words
from hearsay.sources.lookups import MAX_LITERAL_ROWS, small_rows


def classify(
    df: DataFrame,
    lexicon: DataFrame | None = None,
    text_column: str = "cleaned_text",
    match: str = "substring",
    output: str = "sentiment",
    literal_rows: int = MAX_LITERAL_ROWS,
) -> DataFrame:
    """Add the sentiment class: keywords first, then the lexicon's mean polarity.

    Texts decided by a keyword are never tokenised. A lexicon of more than
    ``literal_rows`` is joined by the texts' digests, for the undecided rows only:
    all others cross no shuffle. A stream can't do that itself, so there the
    sink classifies each micro-batch (``sinks.imports_to``).
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    known = {} if lexicon is None else small_lexicon(lexicon, literal_rows)
    if known is not None:
        return df.withColumn(output, s.sentiment_class(text, known, match))
    if df.isStreaming:
        raise ValueError("classify the micro-batches of a stream by so large a lexicon: sinks.imports_to(lexicon=...)")
    asked = df.withColumn("_class", let(F.lower(text), lambda t: s.keyword_class(t, match)))
    decided = asked.filter(F.col("_class").isNotNull()).withColumn(output, F.col("_class"))
    rest = join_polarity(asked.filter(F.col("_class").isNull()).withColumn("_text", text), lexicon, "_text", "_polarity")
    rest = rest.withColumn(output, s.polarity_class(F.col("_polarity"))).drop("_polarity", "_text")
    return decided.unionByName(rest).drop("_class")


def small_lexicon(lexicon: DataFrame, literal_rows: int = MAX_LITERAL_ROWS) -> dict[str, float] | None:
    """The lexicon as a dictionary if it passes the size check, else None."""
    rows = small_rows(lexicon.select("word", "polarity"), literal_rows)
    if rows is None:
        return None
    known: dict[str, float] = {}
    for r in rows:
        if r.word is not None and r.polarity is not None:
            known[r.word] = max(r.polarity, known.get(r.word, r.polarity))
    return known


def add_polarity(df: DataFrame, lexicon: DataFrame, text_column: str, output: str = "polarity") -> DataFrame:
    """Add the mean polarity of the lexicon words in each text (null without any).

    A lexicon that passes the size check becomes literals of the plan: no
    shuffle at all. A larger one is joined, see :func:`join_polarity`.
    """
    known = small_lexicon(lexicon)
    if known is None:
        return join_polarity(df, lexicon, text_column, output)
    return df.withColumn(output, s.lexicon_polarity(words(F.col(text_column)), known))


def join_polarity(df: DataFrame, lexicon: DataFrame, text_column: str, output: str = "polarity") -> DataFrame:
    """:func:`add_polarity` for a lexicon of any size and rows with any key.

    Each distinct text is known by its digest. Its tokens meet the lexicon
    before they are grouped, so that only hits are counted; the sums come back
    by the digest. A text that many rows share is looked up once. Rows without a
    text stay out of the join.
    """
    with_text, without = df.filter(F.col(text_column).isNotNull()), df.filter(F.col(text_column).isNull())
    texts = with_text.select(F.md5(text_column).alias("_digest"), F.col(text_column).alias("_words")).distinct()
    units = F.round(F.col("polarity") * s.SCALE).cast("bigint")
    known = (
        lexicon.filter(F.col("word").isNotNull() & F.col("polarity").isNotNull())
        .groupBy("word")
        .agg(F.max(units).alias("units"))
    )
    sums = (
        texts.select("_digest", F.explode_outer(words(F.col("_words"))).alias("word"))
        .join(known, "word")
        .groupBy("_digest")
        .agg(F.sum("units").alias("_units"), F.count("*").alias("_hits"))
    )
    found = (
        with_text.withColumn("_digest", F.md5(text_column))
        .join(sums, "_digest", "left")
        .withColumn(output, s.mean_polarity(F.col("_units"), F.col("_hits")))
        .drop("_digest", "_units", "_hits")
    )
    return found.unionByName(without.withColumn(output, F.lit(None).cast("double")))
