"""The prefix trie of conversations against a plain Python version."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from hearsay.llm import conversation_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def nodes(spark, rows, **options):
    turns = conversation_trie.sequences(spark.createDataFrame(rows, SCHEMA))
    return sorted((tuple(r) for r in conversation_trie.prefix_trie(turns, **options).collect()), key=str)


def plain(rows):
    """{id: turns} from rows with distinct turn numbers."""
    out = {}
    for i, at, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1])):
        out.setdefault(i, []).append((role or "", text or ""))
    return out


def some_rows(seed, convs=80, vocabulary=4, deepest=7):
    rng, rows = random.Random(seed), []
    for i in range(convs):
        for t in range(rng.randrange(1, deepest)):
            rows.append((i, t, rng.choice(("user", "assistant")), f"t{rng.randrange(vocabulary)}" * (t + 1)))
    return rows


@pytest.mark.parametrize("shard_turns", (1, 7, 60, 1 << 16))
def test_shards_change_nothing(spark, shard_turns):
    rows = some_rows(1)
    assert nodes(spark, rows, shard_turns=shard_turns) == brute.prefix_nodes(plain(rows))


def test_common_first_turns_and_copies(spark):
    """Most conversations start alike, and many are equal as a whole."""
    rows = []
    for i in range(120):
        head = [("system", "be brief"), ("user", "hello")] if i % 3 else []
        for t, (role, text) in enumerate([*head, ("user", f"q{i % 5}"), *([("user", f"r{i}")] if i % 4 == 0 else [])]):
            rows.append((i, t, role, text))
    assert nodes(spark, rows, shard_turns=5) == brute.prefix_nodes(plain(rows))


def test_deep_chain(spark):
    rows = [(1, t, "user", f"turn {t}") for t in range(300)] + [(2, t, "user", f"turn {t}") for t in range(299)]
    got = nodes(spark, rows, shard_turns=10)
    want = []
    ends = {300: "1", 299: "2"}
    chars = [len(f"turn {t}") for t in range(300)]
    for d in range(301):
        saved = sum(chars[max(d, 1) - 1 : 299])
        want.append((1, d, 1 if d else None, 1 + (d < 300), int(d < 300), 1, saved, brute.sha(ends.get(d, ""))))
    assert got == sorted(want, key=str)


def test_double_array_knows_its_sequences_only():
    rng = np.random.default_rng(3)
    paths = sorted({tuple(rng.integers(1, 9, rng.integers(0, 6)).tolist()) for _ in range(300)})
    trie = conversation_trie.DoubleArray([np.array(p, dtype=np.int64) for p in paths], 8)
    known = {p[:d] for p in paths for d in range(len(p) + 1)}
    assert len(trie.order) == len(known) == len(set(trie.order))
    for path in known:
        for code in range(1, 9):
            states = trie.walk(np.array([*path, code]))
            assert (len(states) == len(path) + 2) == ((*path, code) in known)


def test_edge_cases(spark):
    rows = [
        (1, None, "user", "first"),
        (1, 0, None, None),
        (1, 0, None, None),  # a repeated row is a repeated turn
        (2, 5, "user", "first"),
        (2, 7, "", ""),
        (None, 1, "user", "nobody's"),
        (3, 1, "use", "rfirst"),  # role and text are told apart
        (4, 1, "user", "x" * 100_000 + "é\U0001f600"),
    ]
    want = brute.prefix_nodes(
        {1: [("user", "first"), ("", ""), ("", "")], 2: [("user", "first"), ("", "")], 3: [("use", "rfirst")], 4: [("user", rows[-1][3])]}
    )
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("key", "turns", "n", "ends", "digest", "at")})
    turns = conversation_trie.sequences(df)
    assert sorted((tuple(r) for r in conversation_trie.prefix_trie(turns).collect()), key=str) == want
    assert conversation_trie.prefix_trie(turns.where("false")).collect() == []
    alone = conversation_trie.prefix_trie(turns.where("conv_id = 3").withColumn("turns", F.expr("slice(turns, 1, 0)"))).collect()
    assert [tuple(r) for r in alone] == [(3, 0, None, 1, 0, 1, 0, brute.sha("3"))]


def test_query_rebuilds_conversations(spark, tmp_path):
    rows = [r for r in some_rows(5, convs=310) if not 100 <= r[0] < 105 and r[0] != 200]
    rows += [(0, 10 + t, "user", f"long head {t}") for t in range(6)]
    original = plain(rows)
    want = {}
    for i, turns in original.items():
        h = zlib.crc32(str(i).encode()) % 6
        want[i] = original.get(i - i % 100, [])[:h] + turns[h:]
    assert any(not t for t in want.values())
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_conversation_trie(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute.prefix_nodes(want)
