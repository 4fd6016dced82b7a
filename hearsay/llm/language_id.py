"""Language of a text by rank-order profiles of its character n-grams.

A profile lists the ``PROFILE`` most frequent n-grams (1 to 3 letters, with word
borders) of a language. A text's own list is compared with each profile: every
n-gram adds the difference of its two ranks, or the list's length if the profile
lacks it. An n-gram is known by its code points themselves (three of 21 bits). The language with the smallest distance wins, ties by name.

Profiles are learned from all labelled documents; their n-grams are summed in each
task before the shuffle, and only the profiles come to the driver. Prediction is
one pass without a shuffle over whole texts.

Edge cases: null texts and texts without a letter are ``und`` with score 0, as
is everything if nothing was learned. Rows without a label teach nothing.
Repeated rows get equal results. An empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 300
UNKNOWN = "und"

POINT_BITS = 21
GROUP_CHARS = 1 << 19
GROUP_ROWS = 1 << 12


@cache
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case form of each code point, and whether it is a letter."""
    chars = [chr(i) for i in range(0x110000)]
    lower = np.fromiter((ord(c.lower()[0]) for c in chars), dtype=np.uint32, count=len(chars))
    return lower, np.fromiter((c.isalpha() for c in chars), dtype=bool, count=len(chars))


def _groups(texts: pa.Array) -> Iterator[list[str]]:
    group, chars = [], 0
    for text in texts.to_pylist():
        group.append(text or "")
        chars += len(group[-1])
        if chars >= GROUP_CHARS or len(group) == GROUP_ROWS:
            yield group
            group, chars = [], 0
    if group:
        yield group


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and count of each distinct n-gram of some texts, sorted by row and code."""
    lower, letter = _alphabet()
    joined = "\n" + "\n\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rows = np.repeat(np.arange(len(texts), dtype=np.uint32), [len(t) + 2 for t in texts])
    is_letter = letter[points]
    # letters and the borders beside words
    keep = is_letter.copy()
    keep[:-1] |= is_letter[1:]
    keep[1:] |= is_letter[:-1] & ~is_letter[1:]
    symbols = np.where(is_letter, lower[points], 0)[keep].astype(np.uint32)
    rows = rows[keep]
    parts = []
    # 0 stands for a border; the symbols are code points plus 1, so that n-grams of several lengths differ
    wide = symbols.astype(np.uint64)
    for n in (1, 2, 3):
        size = len(symbols) - n + 1
        if size <= 0:
            continue
        code = np.zeros(size, dtype=np.uint64)
        for k in range(n):
            code = (code << np.uint64(POINT_BITS)) | (wide[k : k + size] + np.uint64(1))
        good = rows[:size] == rows[n - 1 :]
        good &= (symbols[:size] != 0) | (symbols[n - 1 :] != 0)
        if n != 2:  # no border inside, or alone
            good &= symbols[n // 2 : n // 2 + size] != 0
        parts.append((rows[:size][good], code[good]))
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    rows, codes = (np.concatenate(c) for c in zip(*parts))
    distinct, number = np.unique(codes, return_inverse=True)
    keys = np.sort(rows.astype(np.int64) * len(distinct) + number)
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.append(begin, len(keys)))
    keys = keys[begin]
    return keys // max(1, len(distinct)), distinct.view(np.int64)[keys % max(1, len(distinct))], counts


def _top(rows: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and rank of the most frequent n-grams of each row, ties by code."""
    order = np.lexsort((codes, -counts, rows))
    rows, codes = rows[order], codes[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = rank < PROFILE
    return rows[keep], codes[keep], rank[keep]


def learn(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> dict[str, list[int]]:
    """The n-gram codes of each language's profile, most frequent first."""
    labelled = docs.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of each group of texts; Spark adds them up in the task before the shuffle."""
        for batch in batches:
            langs, at = np.array(batch.column(0).to_pylist(), dtype=object), 0
            for group in _groups(batch.column(1)):
                rows, codes, counts = ngram_counts(group)
                names, mine = np.unique(langs[at : at + len(group)].astype(str), return_inverse=True)
                at += len(group)
                order = np.lexsort((codes, mine[rows]))
                lang, codes, counts = mine[rows][order], codes[order], counts[order]
                new = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (codes[1:] != codes[:-1]))) if len(codes) else order
                sums = np.add.reduceat(counts, new) if len(codes) else counts
                columns = [pa.array(names[lang[new]], pa.string()), pa.array(codes[new]), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "code", "n"])

    counted = labelled.select(lang_column, text_column).mapInArrow(run, "lang string, code bigint, n bigint")
    sums = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    out: dict[str, list[int]] = {}
    for r in sorted(sums.withColumn("rank", rank).where(F.col("rank") <= PROFILE).collect()):
        out.setdefault(r.lang, []).append((r.rank, r.code))
    return {lang: [code for _, code in sorted(profile)] for lang, profile in sorted(out.items())}


def distances(texts: list[str], profiles: dict[str, list[int]]) -> np.ndarray:
    """Out-of-place distance of each text to each profile, as a share of the largest possible; nan without letters."""
    rows, codes, rank = _top(*ngram_counts(texts))
    most = np.bincount(rows, minlength=len(texts)).astype(float) * PROFILE
    out = np.full((len(texts), len(profiles)), np.nan)
    for j, profile in enumerate(profiles.values()):
        order = np.argsort(profile)
        known = np.array(profile, dtype=np.int64)[order]
        near = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        at = np.where(known[near] == codes, order[near], -1)
        off = np.where(at < 0, PROFILE, np.abs(at - rank))
        total = np.bincount(rows, weights=off, minlength=len(texts))
        np.divide(total, most, out=out[:, j], where=most > 0)
    return out


def predict(
    docs: DataFrame, profiles: dict[str, list[int]], id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, lang_pred, score) of every row; the score is 1 minus the distance's share."""
    kind = docs.schema[id_column].dataType.simpleString()
    names = [*profiles, UNKNOWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
            for group in _groups(batch.column(1)):
                if not profiles:
                    best.append(np.zeros(len(group), dtype=np.int64))
                    score.append(np.zeros(len(group)))
                    continue
                found = distances(group, profiles)
                unknown = np.isnan(found[:, 0])
                found[unknown] = 1.0
                at = found.argmin(axis=1)
                best.append(np.where(unknown, len(profiles), at))
                score.append(np.where(unknown, 0.0, np.clip(1.0 - found[np.arange(len(at)), at], 0.0, 1.0)))
            lang = pa.array([names[i] for i in np.concatenate(best)], type=pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lang, pa.array(np.concatenate(score))], names=[id_column, "lang_pred", "score"]
            )

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, lang_pred string, score double")
