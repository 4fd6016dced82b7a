"""License notices in texts: an exact set-similarity join with templates.

A template is a set of words. A place meets it if a block of consecutive words
around it, at most a quarter longer than the template, holds at least
``containment`` of them, and its telling words, those that no template of another
label has: all of up to ``ALL_TELLING``, half of more. So the one word that names a
license can't be the one that is missing. Words are ordered by their frequency in all documents, so a template's
rarest words are its prefix: a block that reaches the threshold holds at least
one of them (prefix filter). Documents meet templates only there, and texts too
short to hold enough words are left out (positional and length filters). What is
left is verified exactly, inside the join.

Base phrases go the same way, with their rarest word as prefix and equality of
the consecutive words as the verification.

Templates and phrases are parameters of any number and length; they are broadcast
while they have at most ``BROADCAST_WORDS`` words. Texts without any prefix word are sorted out
by one pattern before their words are looked at one by one.

Edge cases: null and empty texts have no words and no labels. Repeated rows get
equal results; rows that share an id but not the text are told apart. An empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.tables import written
from hearsay.llm.words import lower_ascii, words_of

# --- Fixed values: base phrases -------------------------------------------------
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# --- Fixed values: notices of public licenses, as lower-case words ----------------
TEMPLATES = (
    ("mit", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files to deal in the software without restriction",
    ),
    ("mit", "licensed under the terms of the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
        " public license as published by the free software foundation",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that"
        " the following conditions are met",
    ),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
)

CONTAINMENT = 0.8
ALL_TELLING = 3
BROADCAST_WORDS = 100_000
#: Texts are looked at in pieces of so many words, and one longest block more; their neighbours' blocks come along.
PIECE_WORDS = 256


def _keys(docs: DataFrame, text_column: str, phrases: Sequence, templates: Sequence, containment: float) -> list[tuple]:
    """(word, label, entry words, offset in a phrase or -1, needed words, telling words, longest block): the prefix of each entry."""
    entries = [(label, text.split(" "), True) for label, text in phrases]
    entries += [(label, text.split(" "), False) for label, text in templates]
    known = sorted({w for _, words, _ in entries for w in words})
    # outer: else a filter on the array repeats the extraction of the words
    seen = docs.select(F.explode_outer(words_of(F.col(text_column))).alias("word"))
    counts = seen.where(F.col("word").isin(known)).groupBy("word").count()
    count = {r.word: r["count"] for r in counts.collect()}  # at most one row for each word of the entries
    keys = []
    for label, words, phrase in entries:
        order = sorted(set(words), key=lambda w: (count.get(w, 0), w))
        if phrase:
            keys += [(order[0], label, words, words.index(order[0]), len(words), [], len(words))]
        else:
            need = math.ceil(containment * len(order))
            others = {w for other, its, is_phrase in entries if other != label and not is_phrase for w in its}
            telling = sorted(set(words) - others)
            block = len(words) + len(words) // 4
            keys += [(w, label, order, -1, need, telling, block) for w in order[: len(order) - need + 1] if count.get(w)]
    return [k for k in keys if count.get(k[0])]


def places(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """(id, text_hash, label, base, at, score): places of phrases (at: first word) and templates (at: a prefix word), each once."""
    keys = _keys(docs, text_column, phrases, templates, containment)
    spark = docs.sparkSession
    table = spark.createDataFrame(keys, "key string, label string, entry array<string>, offset int, need int, telling array<string>, block int")
    if sum(len(k[2]) for k in keys) <= BROADCAST_WORDS:
        table = F.broadcast(table)
    text = lower_ascii(F.col(text_column))
    found = "|".join(sorted({k[0] for k in keys})) or "(?!)"
    some = docs.where(text.rlike(f"(?:{found})"))
    rows = some.select(
        F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_hash"), words_of(F.col(text_column)).alias("words")
    )
    # a place carries the words of its piece only, with all blocks around it; with all words, rows would grow by the square
    margin = max((k[6] for k in keys), default=1)
    size = PIECE_WORDS + margin
    head = lambda s: F.least(s, F.lit(margin))
    piece = lambda s: F.struct((s - head(s)).alias("base"), head(s).alias("head"), F.slice("words", s - head(s) + 1, head(s) + size + margin).alias("words"))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(size)), piece)
    rows = rows.select("id", "text_hash", F.explode(pieces).alias("piece")).select("id", "text_hash", "piece.*")
    own = F.transform("words", lambda w, i: F.struct(i.alias("p"), w.alias("word")))
    mine = lambda x: (x["p"] >= F.col("head")) & (x["p"] < F.col("head") + size) & x["word"].isin(sorted({k[0] for k in keys}))
    rows = rows.select("id", "text_hash", "base", "words", F.explode(F.filter(own, mine)).alias("_at")).select("id", "text_hash", "base", "words", "_at.*")
    phrase = F.col("offset") >= 0
    start = F.col("p") - F.col("offset")
    here = F.slice("words", F.greatest(start + 1, F.lit(1)), F.size("entry"))
    # the blocks that hold this place; where all their words together are too few, none is looked at
    begin = F.greatest(F.col("p") - F.col("block") + 1, F.lit(0))
    around = F.slice("words", begin + 1, F.col("p") - begin + F.col("block"))
    told = F.when(F.size("telling") <= ALL_TELLING, F.size("telling")).otherwise(F.ceil(F.size("telling") / 2))
    block = lambda s: F.slice("words", s + 1, F.col("block"))
    held = lambda s: F.when(F.size(F.array_intersect("telling", block(s))) >= told, F.size(F.array_intersect("entry", block(s)))).otherwise(0)
    overlap = F.when(
        F.size(F.array_intersect("entry", around)) >= F.col("need"), F.array_max(F.transform(F.sequence(begin, F.col("p")), held))
    ).otherwise(0)
    # all inside the join, so that only verified places become rows
    verified = (F.col("word") == F.col("key")) & (F.size("words") >= F.col("need")) & F.when(
        phrase, (start >= 0) & (here == F.col("entry"))
    ).otherwise(overlap >= F.col("need"))
    joined = rows.join(table, verified)
    score = F.when(phrase, 1.0).otherwise(overlap / F.size("entry"))
    at = F.col("base") + F.when(phrase, start).otherwise(F.col("p"))
    found = joined.select("id", "text_hash", "label", phrase.alias("base"), at.alias("at"), score.alias("score"))
    # equal rows have equal places
    return found.groupBy("id", "text_hash", "label", "base", "at").agg(F.max("score").alias("score"))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options: object) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row; labels as sorted arrays."""
    found = places(docs, id_column, text_column, **options)
    base = F.col("base")
    per_doc = found.groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("at"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("at"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.max("score").alias("score"),
    )
    per_doc = written(per_doc, "licenses")
    rows = docs.select(
        F.col(id_column),
        F.xxhash64(text_column).alias("text_hash"),
        F.size(words_of(F.col(text_column))).cast("long").alias("n_words"),
    )
    out = rows.join(
        per_doc, F.col(id_column).eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left"
    )
    none = F.array().cast("array<string>")
    return out.select(
        id_column,
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", none).alias("base_labels"),
        F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
