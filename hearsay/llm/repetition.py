"""Quality rules on repetition: characters inside repeated n-grams and lines.

Every text is judged alone, in one pass without a shuffle; words, lines and
n-grams of a block of texts are hashed and compared with numpy.

Edge cases: a null, empty or blank text has no words, all counts 0, and fails
the base rule. Equal rows get equal results. An empty table gives an empty
result. Other columns of the input are ignored by :func:`measure` and kept
untouched by :func:`keep_good`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from hearsay.llm.textblocks import Block, blocks, per_row, repeated, rolling

# --- Fixed values: base rule ---------------------------------------------------
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BASE_NGRAM = 3

#: Largest share of a text's word characters inside n-grams, by n, or lines that occur twice or more. Set just above
#: the largest shares of the documents labelled clean (sf0.1: 0.276, 0.276, 0.177 and 0.276); README has what they reject.
MAX_NGRAM_SHARE = {5: 0.30, 7: 0.28, 10: 0.20}
MAX_LINE_SHARE = 0.30

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = (*(f"share_{n}gram" for n in MAX_NGRAM_SHARE), "share_lines")


def _repeated_words(block: Block, n: int) -> np.ndarray:
    """Marks the words inside n-grams that their text holds twice or more."""
    at, hashes = block.ngrams(n)
    begin = at[repeated(block.word_rows[at], hashes)]
    edges = np.zeros(len(block.words) + 1, dtype=np.int64)
    np.add.at(edges, begin, 1)
    np.add.at(edges, begin + n, -1)
    return np.cumsum(edges)[:-1] > 0


def _lines(block: Block, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines equal to an earlier one, and word characters in lines that occur twice or more."""
    breaks = np.flatnonzero(block.data == 0x0A)
    starts = np.union1d(block.offsets[:-1], breaks + 1)
    starts = starts[starts < len(block.data)]
    rows = np.searchsorted(block.offsets, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], len(block.data)), block.offsets[rows + 1])
    ends -= (ends > starts) & (block.data[ends - 1] == 0x0A)
    # a line counts if one of the words starts in it
    words_before = np.searchsorted(block.bounds[0], starts)
    words_after = np.searchsorted(block.bounds[0], ends)
    full = words_after > words_before
    starts, ends, rows = starts[full], ends[full], rows[full]
    hashes = rolling(block.values, starts, ends)
    twice = repeated(rows, hashes)
    sums = np.zeros(len(chars) + 1, dtype=np.int64)
    np.cumsum(chars, out=sums[1:])
    inside = (sums[words_after] - sums[words_before])[full]
    n = len(block)
    keys = np.stack([rows[twice].astype(np.uint64), hashes[twice]], axis=1)
    first = np.unique(keys, axis=0)[:, 0].astype(np.int64) if len(keys) else np.zeros(0, dtype=np.int64)
    again = np.bincount(rows[twice], minlength=n) - np.bincount(first, minlength=n)
    return again, np.bincount(rows[twice], weights=inside[twice], minlength=n).astype(np.int64)


def _measure(block: Block) -> dict[str, np.ndarray]:
    words = block.words_before
    n_words = np.diff(words)
    lead = (block.data & 0xC0) != 0x80
    sums = np.zeros(len(block.data) + 1, dtype=np.int64)
    np.cumsum(lead, out=sums[1:])
    chars = sums[block.bounds[1]] - sums[block.bounds[0]]
    word_chars = per_row(chars, words)
    out = {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": per_row(_IS_SYMBOL[block.data], block.offsets),
        "n_repeat_words": per_row(_repeated_words(block, BASE_NGRAM), words),
    }
    out["n_dup_lines"], line_chars = _lines(block, chars)
    total = np.maximum(word_chars, 1)
    for n in MAX_NGRAM_SHARE:
        out[f"share_{n}gram"] = per_row(np.where(_repeated_words(block, n), chars, 0), words) / total
    out["share_lines"] = line_chars / total
    return out


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts, shares, ``base_failed`` and ``kept`` of each text of a batch."""
    parts = [_measure(b) for b in blocks(texts)]
    out = {
        k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
        for k in (*COUNTS, *SHARES)
    }
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (
        100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"]
    )
    bad = out["share_lines"] > MAX_LINE_SHARE
    for n, most in MAX_NGRAM_SHARE.items():
        bad |= out[f"share_{n}gram"] > most
    out["kept"] = ~(out["base_failed"] | bad)
    return out


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, counts, base_failed, kept, shares) of every row."""
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, base_failed boolean, kept boolean, "
    schema += ", ".join(f"{c} double" for c in SHARES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = measures(batch.column(1))
            columns = [*COUNTS, "base_failed", "kept", *SHARES]
            ints = {c: pa.int64() for c in COUNTS} | {c: pa.float64() for c in SHARES}
            arrays = [pa.array(got[c], type=ints.get(c, pa.bool_())) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_column, *columns])

    return docs.select(id_column, text_column).mapInArrow(run, schema)


def keep_good(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows whose text passes all rules, with all their columns."""
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pc.filter(batch, pa.array(measures(batch.column(at))["kept"], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
