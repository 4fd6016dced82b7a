"""Passages of earlier documents against a plain Python version."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearsay.llm import substring_dedup
from hearsay.llm.textblocks import blocks


def run(df, **options):
    return sorted(tuple(r) for r in substring_dedup.remove_repeats(df, **options).collect())


def frame(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"doc_id {kind}, text string")


@pytest.mark.parametrize("width", (1, 5, 13, 25))
def test_every_pair_of_places_shares_an_anchor(width):
    period, cover, length = substring_dedup.cover_of(width)
    for i in range(period):
        for j in range(period):
            steps = [d for d in range(period) if (i + d) % period in cover and (j + d) % period in cover]
            assert steps and steps[0] + length <= width


def test_anchors_lie_at_cover_positions():
    text = " ".join(f"w{i}" for i in range(40))
    block = next(blocks(pa.array(["too short", text, None, text])))
    at, hashes = substring_dedup.anchors(block, 13)
    want = [2 + k for k in range(34) if k % 7 in (0, 1, 3)]
    assert at.tolist() == want + [40 + k for k in want]
    assert np.array_equal(hashes[: len(want)], hashes[len(want) :])


def test_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = brute.without_repeats([tuple(r) for r in docs.collect()])
    assert run(docs) == want
    assert sum(r[2] for r in want) > 0


@pytest.mark.parametrize("width", (3, 13, 15))
def test_passages_at_any_offset(spark, width):
    """Shared runs just below, at and above the width, at every pair of offsets modulo the period."""
    rng, rows = random.Random(width), []
    shared = [f"s{i}" for i in range(60)]
    for i in range(120):
        own = lambda n: [f"o{i}x{rng.randrange(10**6)}" for _ in range(n)]
        size = rng.choice((width - 1, width, width + 1, 30))
        at = rng.randrange(60 - size + 1)
        rows.append((i, " ".join(own(rng.randrange(9)) + shared[at : at + size] + own(rng.randrange(20)))))
    rng.shuffle(rows)
    assert run(frame(spark, rows).repartition(5), width=width) == brute.without_repeats(rows, width)


def test_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [
        (5, text),
        (5, text),  # a repeated row takes nothing from its copy
        (7, f"a {text}\tb\x0b c"),
        (3, "w0 w1 w2"),
        (4, None),
        (6, ""),
        (8, " \n\t "),
        (9, "é x " + text.upper()),  # case and other blanks count
        (10, " ".join(["same"] * 40)),
        (11, " ".join(["same"] * 13)),
        (12, " ".join(["same"] * 12)),
    ]
    want = brute.without_repeats(rows)
    assert (7, 23, 20, "a b c") in want and (11, 13, 13, "") in want and (12, 12, 0, " ".join(["same"] * 12)) in want
    # rows without an id neither take nor give
    df = frame(spark, [*rows, (None, text), (None, text)])
    df = df.withColumns({c: F.lit("clash") for c in ("id", "chunk", "window", "anchor", "least", "high", "kept", "n_words")})
    got = substring_dedup.remove_repeats(df).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == want
    assert [(r.n_words, r.n_removed, r.kept) for r in got if r.doc_id is None] == [(20, 0, text)] * 2
    assert run(df.where("false")) == []


def test_text_ids_and_long_texts(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [("b", long), ("a", long[1000:200_000]), ("c", "tail " + long[300_000:])]
    assert run(frame(spark, rows, "string")) == brute.without_repeats(rows)


@pytest.mark.parametrize("chunk_bytes", (1, 500))
def test_small_chunks_change_nothing(spark, monkeypatch, chunk_bytes):
    rows = [(i, " ".join(f"w{(i % 7) * 3 + k}" for k in range(30))) for i in range(60)]
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk_bytes)
    assert run(frame(spark, rows)) == brute.without_repeats(rows)
