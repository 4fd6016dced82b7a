"""Links between tokens of two tokenizers against a plain Python version."""

import base64
import json
import os

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearsay.llm import token_alignment
from hearsay.llm.token_alignment import Alignment, Csr, Tokenizers

FOLDER = os.path.dirname(token_alignment.BYTE_BPE)
TEXTS = [
    None,
    "",
    " ",
    "x",
    "the quick brown fox",
    "the quick brown fox",
    "  two  spaces\n\ttabs ",
    "<|endoftext|> and <s>, </s>, <unk>, <0x41>",
    "Übergröße, ça va? 日本語 \U0001f600\U0001f600  nbsp",
    "a▁b",  # the piece mark itself does not come back
    "nul \x00 and \x07",
    "é combining, ﬁ ligature, ​ zero width",
    "word " * 3000,
    "antidisestablishmentarianism" * 40,
]


@pytest.fixture(scope="module")
def tokenizers():
    return Tokenizers.read()


@pytest.fixture(scope="module")
def tokens():
    """Text -> [(id, bytes)] by either tokenizer; the first one's bytes are read from its table of ranks."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(token_alignment.BYTE_BPE)
    first.encode_special_tokens = True
    with open(f"{FOLDER}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    second = SentencePieceProcessor(model_file=token_alignment.PIECE_BPE)

    def of_first(text):
        return [(i, ranks[i]) for i in first.encode(" " + text, add_special_tokens=False).ids]

    def of_second(text):
        out = []
        for i in second.encode(text):
            piece = second.id_to_piece(i)
            out.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
        return out

    return of_first, of_second


def run(df, tokenizers):
    found = token_alignment.align(df, tokenizers)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links"]
    return sorted((tuple(r) for r in found.select(*columns).collect()), key=str)


def test_edge_cases(spark, tokenizers, tokens):
    rows = [*enumerate(TEXTS), (4, TEXTS[4]), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumns({c: F.lit("clash") for c in ("id", "chunk", "pair", "pairs", "at", "of", "n", "best", "own")})
    want = brute.aligned(rows, *tokens)
    assert run(df, tokenizers) == want
    assert [r[1] == 0 for r in want if r[0] in (0, 1, 9)] == [True] * 3
    assert run(df.where("false"), tokenizers) == []


def test_all_documents(spark, sf_dir, tokenizers, tokens):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert run(docs.repartition(3), tokenizers) == brute.aligned([tuple(r) for r in docs.collect()], *tokens)


def test_small_chunks_change_nothing(spark, tokenizers, tokens, monkeypatch):
    from hearsay.llm import textblocks

    rows = [(i, f"text number {i % 7} of the lot, {'more ' * (i % 5)}") for i in range(40)]
    monkeypatch.setattr(textblocks, "BLOCK_BYTES", 64)
    monkeypatch.setattr(token_alignment, "CHUNK_BYTES", 1)
    monkeypatch.setattr(token_alignment, "PRODUCT_ENTRIES", 3)
    batch = pa.RecordBatch.from_pylist([{"id": i, "text": t} for i, t in rows])
    n_links = [0] * len(rows)
    for ids, found in token_alignment._alignments(batch, tokenizers):
        left, right = found.by_bytes()
        for a, _, _ in left.product(right):
            for text in found.text_a[a]:
                n_links[ids[int(text)].as_py()] += 1
    assert n_links == [r[4] for r in sorted(brute.aligned(rows, *tokens))]


def test_links_of_both_kinds(spark, tokenizers, tokens):
    texts = [t for t in TEXTS if t and len(t) < 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for kind in ("overlap", "group"):
        got = {tuple(r) for r in token_alignment.token_links(df, tokenizers, kind).collect()}
        want = set()
        for key, text in enumerate(texts):
            a, b = (t(text) for t in tokens)
            if b"".join(x for _, x in a) != b"".join(x for _, x in b):
                continue
            end_a, end_b = np.cumsum([len(x) for _, x in a]), np.cumsum([len(x) for _, x in b])
            cuts = sorted(set(end_a) & set(end_b))
            for i, (x, p) in enumerate(a):
                for j, (y, q) in enumerate(b):
                    shared = min(end_a[i], end_b[j]) - max(end_a[i] - len(p), end_b[j] - len(q))
                    same = np.searchsorted(cuts, end_a[i]) == np.searchsorted(cuts, end_b[j])
                    if shared > 0 if kind == "overlap" else same:
                        want.add((key, i, j, x, y, int(shared) if kind == "overlap" else 1))
        assert got == want
    with pytest.raises(ValueError):
        token_alignment.token_links(df, tokenizers, "other")


def test_products_are_matrix_products():
    rng = np.random.default_rng(11)
    for _ in range(20):
        n, k, m = rng.integers(1, 12, 3)
        first, second = rng.random((n, k)) < 0.3, rng.random((k, m)) < 0.3

        def sparse(dense):
            return Csr(np.append(0, np.cumsum(dense.sum(axis=1))), np.nonzero(dense)[1], dense.shape[1])

        out = np.zeros((n, m), dtype=int)
        for rows, columns, values in sparse(first).product(sparse(second)):
            out[rows, columns] = values
        assert np.array_equal(out, first.astype(int) @ second.astype(int))
        back = sparse(first).transposed()
        assert np.array_equal(np.diff(back.starts), first.sum(axis=0)) and len(back) == k


def test_both_encoders_agree_on_every_character(tokenizers, tokens):
    """The encoder chosen for the file, and the library that defines it."""
    encode, _ = token_alignment._byte_bpe(tokenizers.first)
    texts = []
    for base in range(0, 0x110000, 64):
        found = [chr(c) for c in range(base, base + 64) if not 0xD800 <= c < 0xE000]
        texts.append(" ".join(f"a{c}1{c}{c} {c}!{c}'s" for c in found))
    texts += ["\n" * 3000 + "x", "ab" * 5000, "don't  stop'RE 123456 <|endoftext|>"]
    for text, ids in zip(texts, encode([" " + t for t in texts])):
        assert ids == [i for i, _ in tokens[0](text)]


def test_other_merges_are_read_by_the_library(tokenizers, tokens):
    """With the ids of two merges exchanged, the ids no longer follow the merges."""
    told = json.loads(tokenizers.first)
    vocabulary, merges = told["model"]["vocab"], told["model"]["merges"]
    one, two = ("".join(merges[i]) for i in (0, 300))
    vocabulary[one], vocabulary[two] = vocabulary[two], vocabulary[one]
    encode, table = token_alignment._byte_bpe(json.dumps(told).encode())
    change = {vocabulary[one]: vocabulary[two], vocabulary[two]: vocabulary[one]}
    text = "the quick brown fox tries another thing"
    assert encode([" " + text]) == [[change.get(i, i) for i, _ in tokens[0](text)]]
    assert table.joined(np.array(encode([" " + text])[0])).tobytes() == (" " + text).encode()


def test_alignment_gives_texts_back(tokenizers):
    found = Alignment(TEXTS, tokenizers)
    kept = b"".join((" " + TEXTS[i]).encode() for i in found.texts)
    assert found.vocabulary_a.joined(found.a).tobytes() == kept == found.vocabulary_b.joined(found.b).tobytes()
    assert found.ends_a[-1] == found.ends_b[-1] == found.cuts[-1] == len(kept)
