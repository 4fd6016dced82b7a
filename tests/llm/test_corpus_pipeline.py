"""The pipeline's stages against plain Python, each on the rows its predecessor kept."""

import brute
import pytest

import corpus_pipeline
from hearsay.llm import line_dedup, repetition
from hearsay.llm.textblocks import blocks


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """Rows after each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        out.append(rows)
    return out


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_stages_are_the_asked_ones():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "mix_sources"]


def test_columns(kept):
    for rows in kept[1:-1]:
        assert rows[0].__fields__ == corpus_pipeline.COLUMNS


def _shares(text):
    """Share of word characters inside n-grams and lines that occur twice or more."""
    found = [(m.start(), m[0]) for m in brute.TOKEN.finditer(text or "")]
    words = [w for _, w in found]
    total = max(1, sum(map(len, words)))
    out = {}
    for n in repetition.MAX_NGRAM_SHARE:
        seen = {}
        for i in range(len(words) - n + 1):
            seen.setdefault(tuple(words[i : i + n]), []).append(i)
        inside = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(n)}
        out[n] = sum(len(words[i]) for i in inside) / total
    lines = [line for line in (text or "").split("\n") if brute.TOKEN.search(line)]
    out["lines"] = sum(len("".join(brute.TOKEN.findall(x))) for x in lines if lines.count(x) > 1) / total
    return out


def test_quality_rules(kept):
    want = set()
    for r in kept[0]:
        n_words, _, _, _, n_repeat = brute.repetition(r.text)
        shares = _shares(r.text)
        bad = n_words < 50 or 100 * n_repeat > 50 * n_words or shares.pop("lines") > repetition.MAX_LINE_SHARE
        if not bad and all(share <= repetition.MAX_NGRAM_SHARE[n] for n, share in shares.items()):
            want.add(r.doc_id)
    assert set(texts(kept[1])) == want and len(kept[1]) == len(want)
    assert texts(kept[1]).items() <= texts(kept[0]).items()


def test_line_dedup(kept):
    hosts = {}
    for r in kept[1]:
        pages, lines = hosts.setdefault(r.source, ([], {}))
        pages.append(r.doc_id)
        for line in set(r.text.split("\n")):
            if brute.TOKEN.search(line):
                lines[line] = lines.get(line, 0) + 1
    want = {}
    for r in kept[1]:
        pages, lines = hosts[r.source]
        drop = {x for x, n in lines.items() if 10 * n > len(pages) + 20}
        want[r.doc_id] = "\n".join(x for x in r.text.split("\n") if x not in drop)
    assert texts(kept[2]) == want
    assert all(r.n_chars == len(r.text) for r in kept[2])


def test_near_copies_of_five_words(kept):
    want = brute.components(texts(kept[2]), 5, 80)
    assert sorted(texts(kept[3])) == sorted(i for i, (_, component) in want.items() if component == i)


def test_near_copies_at_80_percent(spark):
    """Groups of texts on both sides of 80 % of five words; short ones have empty parts."""
    import random

    rng, rows = random.Random(5), []
    for k in range(60):
        size = rng.choice((6, 9, 14, 25, 60, 150))
        base = [f"b{k}x{i}" for i in range(size)]
        for _ in range(4):
            found = list(base)
            for _ in range(rng.choice((0, 1, 1, 2))):
                found[rng.choice((0, 1, size // 2, size - 2, size - 1))] = f"e{rng.randrange(999)}"
            rows.append((len(rows), " ".join(found), "en", "s", 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = brute.components({r[0]: r[1] for r in rows}, 5, 80)
    assert want != brute.components({r[0]: r[1] for r in rows})
    kept = corpus_pipeline.near_copies(spark, df, "").collect()
    assert sorted(texts(kept)) == sorted(i for i, (_, component) in want.items() if component == i)


def test_decontamination(kept, spark, sf_dir):
    items = {r.item_id: brute.words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {i for i, t in texts(kept[3]).items() if not brute.contamination(t, items)[1]}
    assert set(texts(kept[4])) == want and len(kept[4]) == len(want)


def test_mix(kept):
    sizes, taken = {}, {}
    for r in kept[4]:
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.TOKEN.findall(r.text))
    for r in kept[5]:
        assert r.text == texts(kept[4])[r.doc_id] and 1 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    largest = max(r.size for r in kept[5])
    for r in kept[5]:
        assert r.source_size == sizes[r.source] and abs(taken[r.source] - r.target) <= largest


def test_block_boundaries_change_nothing(monkeypatch):
    """Texts of a batch cut into blocks of other sizes get the same results."""
    import numpy as np
    import pyarrow as pa

    from hearsay.llm import textblocks

    batch = pa.array([None, "a b a b a b", "", "x\ny\nx é é", "long " * 500, "tail"])
    whole = repetition.measures(batch)
    monkeypatch.setattr(textblocks, "BLOCK_BYTES", 8)
    assert len(list(blocks(batch))) > 1
    for name, values in repetition.measures(batch).items():
        assert np.array_equal(values, whole[name]), name
    for name, values in repetition.measures(batch.slice(3)).items():
        assert np.array_equal(values, whole[name][3:]), name


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids, texts and sources, empty and repeated rows go through all five stages; an empty table stays empty."""
    good = lambda k: "\n".join(" ".join(f"w{k}x{i}y{j}" for j in range(9)) for i in range(9))
    benchmark = " ".join(f"b{i}" for i in range(12))
    rows = [
        (1, good(1), "en", "s", 1),
        (1, good(1), "en", "s", 1),
        (2, good(1), None, None, None),
        (None, good(2), "en", "s", 2),
        (3, None, "en", "s", None),
        (4, "", None, "s", 0),
        (5, good(5) + "\n" + benchmark, "en", None, 5),
        (6, good(6), "de", "t", 6),
        (7, "short", "de", "t", 5),
        (8, "same words " * 60, "de", "t", 5),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, benchmark), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, empty = [], docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        found = docs.collect()
        docs = spark.createDataFrame(found, docs.schema)
        kept.append(sorted((r.doc_id for r in found), key=str))
        empty = stage(spark, empty, str(tmp_path))
        assert empty.columns == docs.columns and empty.count() == 0, name
        empty = spark.createDataFrame([], empty.schema)
    assert kept[0] == kept[1] == [1, 1, 2, 5, 6, None]  # too short or too repetitive ones are gone
    assert kept[2] == [1, 5, 6, None]  # one of the copies, by id
    assert kept[3] == [1, 6, None]
    assert set(kept[4]) <= {1, 6, None}
