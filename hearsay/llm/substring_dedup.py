"""Passages that an earlier document holds: difference-cover anchors.

A window is ``width`` consecutive words of one document. A word goes if a window
over it has the same words as a window of a document with a smaller id. All is
judged on the input, not on what is left.

1. Anchors are shorter runs of words, hashed only where their word number, modulo
   a period, lies in a difference cover. For any two places some step below the
   period leads both to cover positions at once, so two equal windows share an
   anchor at the same place of both, wherever they begin. Period and anchor are
   such that it lies inside the window.
2. Anchors are counted by hash; those of two texts or more are shared. Texts are
   dealt to chunks by a hash of id and text, and each chunk learns which of its
   anchors are shared.
3. In a chunk, each place of a shared anchor is extended to the windows that hold
   it, named by 96 bits of hash. A chunk's distinct windows are grouped over all
   chunks, so a passage of a third of all documents counts once in each chunk.
   The smallest id of a window comes back to the chunks that have it, where the
   words under it are left out.

Chunks hold about ``CHUNK_BYTES`` of text at every size of the table. Texts go to
their chunks twice, to be extended and to be cut; nothing is sent to all tasks.

Edge cases: null, empty and blank texts have no words; texts of fewer words than
a window lose none. Repeated rows and rows that share an id take nothing from each
other, but from smaller ids. Rows without an id have no place in the order: they
take nothing and lose nothing. A text is handled as a whole, however long. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.tables import discard, written
from hearsay.llm.textblocks import Block, blocks, mix, rolling

WIDTH = 13
#: Perfect difference sets by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Text of a chunk, about.
CHUNK_BYTES = 1 << 21

_OTHER = np.uint64(0xA24BAED4963EE407)


def cover_of(width: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor length: the longest period whose anchors are no shorter than it."""
    period = max(p for p in COVERS if 2 * p - 1 <= width)
    return period, COVERS[period], width - period + 1


def anchors(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index in the block and hash of each anchor, in texts that hold a window."""
    period, cover, length = cover_of(width)
    at, hashes = block.ngrams(length)
    rows = block.word_rows[at]
    before = block.words_before
    use = np.isin((at - before[rows]) % period, cover) & (before[rows + 1] - before[rows] >= width)
    return at[use], hashes[use]


def _anchors(docs: DataFrame, width: int) -> DataFrame:
    """(anchor, chunk) of every anchor of (chunk, id, text), each once for a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                at, hashes = anchors(block, width)
                rows = block.word_rows[at]
                order = np.lexsort((hashes, rows))
                rows, hashes = rows[order], hashes[order]
                new = np.ones(len(rows), dtype=bool)
                new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
                chunks = batch.column(0).take(pa.array(block.first + rows[new]))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[new].view(np.int64)), chunks], names=["anchor", "chunk"])

    return docs.where("id is not null").select("chunk", "text").mapInArrow(run, "anchor bigint, chunk int")


def _spread(starts: np.ndarray, ends: np.ndarray, total: int) -> np.ndarray:
    """Marks the places inside any of the ranges."""
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge)[:-1] > 0


def _names(block: Block, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes, of 64 and 32 bits, of the windows that begin at some words."""
    high = rolling(block.words, at, at + width)
    low = rolling(mix(block.words ^ _OTHER), at, at + width) >> np.uint64(32)
    return high.view(np.int64), low.astype(np.uint32).view(np.int32)


def _extended(docs: DataFrame, shared: DataFrame, width: int) -> DataFrame:
    """(chunk, high, low, least, most): each chunk's distinct windows that hold a shared anchor, and their smallest and largest id."""
    kind = docs.schema["id"].dataType.simpleString()
    period, _, _ = cover_of(width)

    def run(key: tuple, rows: pa.Table, known: pa.Table) -> pa.Table:
        wanted = np.unique(known["anchor"].to_numpy()).view(np.uint64)
        ids = rows["id"].combine_chunks()
        rank = pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))]
        for block in blocks(rows["text"].combine_chunks()):
            at, hashes = anchors(block, width)
            at = at[np.isin(hashes, wanted)]
            row = block.word_rows[at]
            from_, to = np.maximum(at - period + 1, block.words_before[row]), np.minimum(at, block.words_before[row + 1] - width)
            starts = np.flatnonzero(_spread(from_, to + 1, len(block.words)))
            found.append((*_names(block, starts, width), block.first + block.word_rows[starts]))
        high, low, row = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((rank[row], low, high))
        high, low, row = high[order], low[order], row[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(row))[: len(begin)] - 1
        chunk = pa.array(np.full(len(begin), key[0].as_py(), dtype=np.int32))
        columns = [pa.array(high[begin]), pa.array(low[begin]), ids.take(pa.array(row[begin])), ids.take(pa.array(row[end]))]
        return pa.table([chunk, *columns], names=["chunk", "high", "low", "least", "most"])

    left = docs.where("id is not null").groupBy("chunk")
    right = shared.select(F.col("chunk").alias("of"), "anchor").groupBy("of")
    return left.cogroup(right).applyInArrow(run, f"chunk int, high bigint, low int, least {kind}, most {kind}")


def _cut(docs: DataFrame, back: DataFrame, width: int) -> DataFrame:
    """(id, n_words, n_removed, kept) of (chunk, id, text), given (chunk, high, low, first): windows and the smallest id that has them."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(key: tuple, rows: pa.Table, known: pa.Table) -> pa.Table:
        rows, known = rows.combine_chunks(), known.combine_chunks()
        ids = rows["id"].combine_chunks()
        first = known["first"].combine_chunks().cast(ids.type)
        rank = pc.rank(pa.concat_arrays([ids, first]), sort_keys="ascending", null_placement="at_start", tiebreaker="dense")
        rank = rank.to_numpy().astype(np.int64)
        rank[: len(ids)][ids.is_null().to_numpy(zero_copy_only=False)] = -1  # below every id: such rows lose nothing
        names = np.zeros(known.num_rows, dtype=[("high", np.int64), ("low", np.int32)])
        names["high"], names["low"] = known["high"].to_numpy(), known["low"].to_numpy()
        order = np.argsort(names)
        names, smallest = names[order], rank[len(ids) :][order]
        n_words, n_removed, kept = [], [], []
        for block in blocks(rows["text"].combine_chunks()):
            at, high = np.zeros(0, dtype=np.int64), None
            if len(names):
                at, high = block.ngrams(width)
                hit = np.isin(high.view(np.int64), names["high"])
                at = at[hit]
            mine = np.zeros(len(at), dtype=names.dtype)
            mine["high"], mine["low"] = _names(block, at, width)
            place = np.minimum(np.searchsorted(names, mine), max(len(names) - 1, 0))
            if len(at):
                at = at[(names[place] == mine) & (smallest[place] < rank[block.first + block.word_rows[at]])]
            gone = _spread(at, at + width, len(block.words))
            data, starts, ends = block.data.tobytes(), *(b.tolist() for b in block.bounds)
            cuts = block.words_before.tolist()
            removed = np.concatenate([[0], np.cumsum(gone)])
            for a, b in zip(cuts[:-1], cuts[1:]):
                n = int(removed[b] - removed[a])
                words = range(a, b) if not n else (a + np.flatnonzero(~gone[a:b])).tolist()
                n_words.append(b - a)
                n_removed.append(n)
                kept.append(b" ".join(data[starts[w] : ends[w]] for w in words).decode())
        counts = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
        return pa.table([ids, *counts, pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    right = back.select(F.col("chunk").alias("of"), "high", "low", "first").groupBy("of")
    return docs.groupBy("chunk").cogroup(right).applyInArrow(run, f"id {kind}, n_words bigint, n_removed bigint, kept string")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_words, n_removed, kept) of every row; ``kept`` has the words that stay, joined by one space."""
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk = F.pmod(F.xxhash64("id", "text"), F.lit(size // CHUNK_BYTES + 1)).cast("int")
    docs = docs.select(chunk.alias("chunk"), "id", "text")

    counts = _anchors(docs, width).groupBy("anchor").agg(F.count("*").alias("n"))
    common = written(counts.where("n > 1").select("anchor"), "common-anchors")
    shared = written(_anchors(docs, width).join(common, "anchor", "left_semi"), "shared-anchors")
    discard(common)

    over = "over (partition by high, low)"
    windows = _extended(docs, shared, width).selectExpr("*", f"min(least) {over} first", f"max(most) {over} last")
    back = written(windows.where("first < most").select("chunk", "high", "low", "first"), "earlier-windows")
    discard(shared)
    return _cut(docs, back, width).withColumnRenamed("id", id_column)
