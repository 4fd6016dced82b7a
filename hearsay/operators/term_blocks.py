"""Texts in blocks: the term counts of many texts as one row, for tasks that work on arrays.

A block names each of its terms once, so what is known of a term reaches a block
as one row, whatever number of its texts hold the term.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.sources.scratch import written

#: Tokens in a block, and pairs of a block and a term in a part of the terms, about.
BLOCK_TOKENS = 1 << 21
PART_PAIRS = 1 << 18


def term_blocks(tokens: DataFrame, key: str) -> DataFrame:
    """(block, keys, ends, terms, at, n): how often each text of (key, tokens) holds each term, as a written table.

    ``keys`` are the texts (rows with one key are one text), ``terms`` the distinct
    terms in order; ``at`` (place in ``terms``) and ``n`` (count) have one item per
    text and term, text by text, and ``ends`` tells where each text ends. Tokens
    are shuffled as they are, one row per text, and counted in their block.
    """
    kind = tokens.schema[key].dataType.simpleString()
    rows = tokens.select(F.col(key).alias("key"), F.filter("tokens", lambda t: t.isNotNull()).alias("tokens")).where("size(tokens) > 0")
    number = max(1, math.ceil((rows.agg(F.sum(F.size("tokens"))).first()[0] or 0) / BLOCK_TOKENS))
    rows = rows.select(F.pmod(F.xxhash64("key"), F.lit(number)).cast("int").alias("block"), "key", "tokens")
    schema = f"block int, keys array<{kind}>, ends array<int>, terms array<string>, at array<int>, n array<double>"
    return written(rows.groupBy("block").applyInArrow(_packed, schema), "term-blocks")


def _row(**columns: object) -> pa.Table:
    """One row; arrays become a list each."""
    one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v))
    return pa.table({name: pa.array([v], pa.int32()) if isinstance(v, int) else one(v) for name, v in columns.items()})


def _packed(table: pa.Table) -> pa.Table:
    keys = pa.concat_arrays(table["key"].chunks).dictionary_encode(null_encoding="encode")
    lengths = pc.list_value_length(table["tokens"]).to_numpy()
    tokens = pa.concat_arrays([c.flatten() for c in table["tokens"].chunks]).dictionary_encode()
    in_order = pc.sort_indices(tokens.dictionary)
    rank = np.empty(len(in_order), np.int64)
    rank[in_order.to_numpy()] = np.arange(len(in_order))
    pairs = np.repeat(keys.indices.to_numpy().astype(np.int64), lengths) * len(in_order) + rank[tokens.indices.to_numpy()]
    pairs, n = np.unique(pairs, return_counts=True)
    ends = np.cumsum(np.bincount(pairs // len(in_order), minlength=len(keys.dictionary))).astype(np.int32)
    return _row(
        block=table["block"][0].as_py(), keys=keys.dictionary, ends=ends, terms=tokens.dictionary.take(in_order),
        at=(pairs % len(in_order)).astype(np.int32), n=n.astype(float),
    )


def term_parts(blocks: DataFrame) -> DataFrame:
    """(part, block, places, at, terms): the terms of all blocks in parts, as a written table.

    A part has one row with its distinct ``terms`` in order and without a block,
    and one for each block that holds some: their ``places`` there and, likewise, ``at`` here.
    """
    rows = blocks.select("block", F.posexplode("terms").alias("i", "term"))
    number = max(1, math.ceil((blocks.agg(F.sum(F.size("terms"))).first()[0] or 0) / PART_PAIRS))
    rows = rows.select(F.pmod(F.xxhash64("term"), F.lit(number)).cast("int").alias("part"), "block", "i", "term")
    schema = "part int, block int, places array<int>, at array<int>, terms array<string>"
    return written(rows.groupBy("part").applyInArrow(_parted, schema), "term-parts")


def _parted(table: pa.Table) -> pa.Table:
    terms = pa.concat_arrays(table["term"].chunks).dictionary_encode()
    in_order = pc.sort_indices(terms.dictionary)
    rank = np.empty(len(in_order), np.int32)
    rank[in_order.to_numpy()] = np.arange(len(in_order), dtype=np.int32)
    block, i = table["block"].to_numpy(), table["i"].to_numpy()
    order = np.lexsort((i, block))
    found, first = np.unique(block[order], return_index=True)
    bounds = pa.array([*first, len(order), len(order)], pa.int32())
    held = lambda v: pa.ListArray.from_arrays(bounds, pa.array(v[order].astype(np.int32)))
    own = pa.ListArray.from_arrays(pa.array([0] * (len(found) + 1) + [len(in_order)], pa.int32()), terms.dictionary.take(in_order))
    blocks = pa.array([*found.tolist(), None], pa.int32())
    parts = pa.array([table["part"][0].as_py()] * len(blocks), pa.int32())
    return pa.table({"part": parts, "block": blocks, "places": held(i), "at": held(rank[terms.indices.to_numpy()]), "terms": own})


def on_blocks(
    blocks: DataFrame, weights: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, *columns: str
) -> DataFrame:
    """``run`` over each block: its terms that have weights, (i, term, weights) in order of i, and its row of ``columns``."""
    terms = blocks.select("block", F.posexplode("terms").alias("i", "term")).join(weights, "term").select("block", "i", "term", "weights")
    rows = blocks.select("block", *columns).toDF("block", *columns)  # its own columns: both sides come from one table
    ordered = lambda known, own: run(known.sort_by("i"), own)
    return terms.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(ordered, schema)


def numbers(table: pa.Table, column: str) -> np.ndarray:
    """The items of the lists in a column, one after the other."""
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table[column].chunks] or [np.zeros(0)])


def sums_by(at: np.ndarray, shares: np.ndarray, size: int) -> pa.Array:
    """For each place, the sum of the columns of ``shares`` (topics, pairs) there, as a list."""
    sums = np.stack([np.bincount(at, weights=s, minlength=size) for s in shares], axis=1)
    return lists(sums)


def lists(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as a list."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.ascontiguousarray(rows, dtype=float).ravel()))
