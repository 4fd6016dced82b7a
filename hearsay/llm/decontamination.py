"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window is ``width`` consecutive words of an item (a shorter item is one
window). Containment of a window is exact, so one of its words is prefix enough:
the rarest, by the words' frequency in the documents. Documents meet the windows
on these words only; length and positional bounds drop places where the window
can't fit, and what is left is verified word by word, inside the join.

Documents are never shuffled by their words: windows are joined in blocks of
about ``KEY_BYTES``, which bounds the broadcast.

Edge cases: null and empty texts have no words and are clean. Items without
words never occur; equal items are found together. Repeated document rows get
equal results; rows that share an id but not the text are told apart. Empty
tables give no hits. Other columns, whatever their names, are ignored by
:func:`contamination` and kept by :func:`drop_contaminated`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.llm.tables import written
from hearsay.llm.words import words_of

WIDTH = 10
KEY_BYTES = 4 << 20


def window_keys(docs: DataFrame, items: DataFrame, text_column: str, width: int) -> DataFrame:
    """(h, item_id, offset, window): each window with its rarest word and where in the window that stands."""
    words = items.select("item_id", words_of(F.col("text")).alias("words")).distinct().where(F.size("words") > 0)
    need = F.least(F.size("words"), F.lit(width))
    starts = F.sequence(F.lit(1), F.size("words") - need + 1)
    windows = words.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, need))).alias("window"))
    windows = written(windows.distinct(), "benchmark-windows")
    placed = windows.select("item_id", "window", F.posexplode("window").alias("offset", "word"))
    placed = placed.select("item_id", "window", "offset", F.xxhash64("word").alias("h"))

    known = written(placed.select("h").distinct(), "benchmark-known")
    # outer: else a filter on the array repeats the extraction of the words
    seen = docs.select(F.explode_outer(words_of(F.col(text_column))).alias("word")).select(F.xxhash64("word").alias("h"))
    df = seen.join(known, "h", "left_semi").groupBy("h").agg(F.count("*").alias("df"))
    rarest = placed.join(df, "h").groupBy("item_id", "window").agg(
        F.min(F.struct("df", "h", "offset")).alias("key"), F.count("*").alias("present")
    )
    # a window with a word that no document holds can't occur
    rarest = rarest.where(F.col("present") == F.size("window"))
    return rarest.select("key.h", "item_id", "key.offset", "window")


def hits(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH
) -> DataFrame:
    """(id, text_hash, item_id, first, last): places where a window of an item stands."""
    keys = written(window_keys(docs, items, text_column, width), "benchmark-keys")
    chars = F.aggregate("window", F.lit(100), lambda n, w: n + F.octet_length(w))
    blocks = -(-(keys.agg(F.sum(chars)).first()[0] or 1) // KEY_BYTES)
    texts = docs.select(
        F.col(id_column).alias("id"),
        F.xxhash64(text_column).alias("text_hash"),
        words_of(F.col(text_column)).alias("words"),
    )
    placed = texts.select("id", "text_hash", "words", F.posexplode_outer("words").alias("p", "word"))
    placed = placed.withColumn("wh", F.xxhash64("word")).drop("word")
    first = F.col("p") - F.col("offset")
    found = []
    for b in range(blocks):
        some = keys.where(F.pmod(F.xxhash64("item_id", "window"), F.lit(blocks)) == b) if blocks > 1 else keys
        # all inside the join, so that only verified places become rows
        verified = (
            (F.col("wh") == F.col("h"))
            & (first >= 0)
            & (first + F.size("window") <= F.size("words"))
            & (F.slice("words", F.greatest(first + 1, F.lit(1)), F.size("window")) == F.col("window"))
        )
        joined = placed.join(F.broadcast(some), verified)
        found.append(
            joined.select("id", "text_hash", "item_id", first.alias("first"), (first + F.size("window") - 1).alias("last"))
        )
    return reduce(DataFrame.unionAll, found).distinct()


def _covered(runs: Column) -> Column:
    """Number of positions in the union of (first, last) runs, sorted by first."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("last"))

    def add(seen: Column, run: Column) -> Column:
        fresh = F.greatest(F.lit(0), run["last"] - F.greatest(run["first"] - 1, seen["last"]))
        return F.struct((seen["n"] + fresh).alias("n"), F.greatest(seen["last"], run["last"]).alias("last"))

    return F.aggregate(runs, start, add, lambda s: s["n"])


def contamination(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated) of every row; items sorted as strings."""
    found = hits(docs, items, id_column, text_column, width)
    per_doc = found.groupBy("id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("first", "last"))).alias("runs"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    per_doc = per_doc.select(
        F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), _covered(F.col("runs")).alias("n_hit"), "items"
    )
    rows = docs.select(
        F.col(id_column),
        F.xxhash64(text_column).alias("text_hash"),
        F.size(words_of(F.col(text_column))).cast("long").alias("n_words"),
    )
    out = rows.join(
        per_doc, F.col(id_column).eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left"
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        id_column,
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_found).cast("long").alias("n_items"),
        items_found.alias("items"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH
) -> DataFrame:
    """The rows whose text holds no window of an item."""
    bad = hits(docs, items, id_column, text_column, width)
    bad = bad.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col(id_column).eqNullSafe(F.col("_id")) & (F.xxhash64(text_column) == F.col("_hash"))
    return docs.join(written(bad, "contaminated"), same, "left_anti")
