"""Registered corpus queries against SQL, brute force or held-out labels, on the smallest tables."""

import zlib

import brute
import pytest

from checks.compare import connect, difference
from hearsay.llm.oracle import ORACLE_SQL
from hearsay.llm.queries import QUERIES


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name]) is None


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_pii_base_spans(spark, sf_dir, documents):
    rows = QUERIES["op1_pii"](spark, sf_dir).collect()
    assert len(rows) == len(documents)
    for r in rows:
        counts, digest, spans = brute.pii(documents[r.doc_id].text)
        assert ((r.n_email, r.n_ip, r.n_card, r.n_phone), r.base_sha256) == (counts, digest)
        assert set(filter(None, spans.split(","))) <= set(r.spans.split(","))


def test_language_held_out(spark, sf_dir, documents):
    rows = QUERIES["op2_language_id"](spark, sf_dir).collect()
    assert len(rows) == len(documents)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in documents if zlib.crc32(str(i).encode()) % 3 == 1}
    right = sum(r.lang_pred == documents[r.doc_id].lang for r in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_urls(spark, sf_dir):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op4_url_graph"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path, rule, verdict = brute.url(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_quality_held_out(spark, sf_dir, documents):
    rows = {r.doc_id: r for r in QUERIES["op6_quality_mil"](spark, sf_dir).collect()}
    assert len(rows) == len(documents)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    held = [x for x in labels if rows[x.doc_id].held_out]
    assert sum(rows[x.doc_id].predicted == x.quality for x in held) >= 0.9 * len(held)


def test_jaccard_components(spark, sf_dir, documents):
    rows = QUERIES["op7_jaccard_join"](spark, sf_dir).collect()
    want = brute.components({i: r.text for i, r in documents.items()})
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want


def test_repetition_base(spark, sf_dir, documents):
    rows = QUERIES["op8_repetition"](spark, sf_dir).collect()
    assert len(rows) == len(documents)
    for r in rows:
        want = brute.repetition(documents[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_license_base(spark, sf_dir, documents):
    rows = QUERIES["op10_licenses"](spark, sf_dir).collect()
    assert len(rows) == len(documents)
    for r in rows:
        want = brute.licenses(documents[r.doc_id].text)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert (r.score > 0) == bool(r.labels)
