"""Which tokens of two tokenizers cover the same bytes of a text.

Tokens are rows of incidence matrices in compressed sparse rows (CSR), built by
hand: token x byte for both tokenizers, and token x group, where groups are cut
at the byte offsets at which tokens of both end. Products of these matrices are
the links, found row by row as Gustavson did (the rows of the second matrix that
a row of the first names are added up):

* A x B' over bytes: pairs of tokens that overlap, with the bytes they share;
* A x B' over groups: pairs of tokens of the same group.

Texts of about ``BLOCK_BYTES`` are one block-diagonal matrix; products are made for
a bounded range of rows at a time.

:func:`align` also counts, over all documents, how many hold a pair of token ids
linked. Pairs are counted per chunk of consecutive documents first, so a pair
that every document holds is one row per chunk; the counts come back to the
chunks that have the pair, never to the driver, and no table of pairs is sent to
all tasks. A text's pairs are kept as numbers in its chunk.

Tokenizers are given as files that the driver reads; their bytes (of a fixed
size) go to the tasks. The first is a byte-level BPE in the json form of
``tokenizers`` (without special tokens), the second a ``sentencepiece`` model. Neither adds special tokens,
and the strings of special tokens in a text are plain text.

Edge cases: texts that are null, empty, or that a tokenizer does not give back
byte for byte have no tokens, so all counts are 0. Each row is a document,
repeated rows and rows without an id too. Texts are encoded as a whole, however
long. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.tables import written
from hearsay.llm.textblocks import blocks

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"

#: Text bytes of a chunk, about: its pairs are numbered together.
CHUNK_BYTES = 1 << 24
#: Entries that a range of rows of a product may expand to, about.
PRODUCT_ENTRIES = 1 << 20
#: Bits of the second tokenizer's ids in a pair of ids.
ID_BITS = 24


# -- sparse matrices ----------------------------------------------------------


@dataclass
class Csr:
    """A matrix of zeros and ones: columns of row i are ``columns[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    @classmethod
    def partition(cls, ends: np.ndarray, total: int) -> "Csr":
        """Rows that own consecutive columns, up to each of ``ends``."""
        return cls(np.concatenate([[0], ends]).astype(np.int64), np.arange(total, dtype=np.int64), total)

    @classmethod
    def one_each(cls, columns: np.ndarray, width: int) -> "Csr":
        """Rows with one column each."""
        return cls(np.arange(len(columns) + 1, dtype=np.int64), columns.astype(np.int64), width)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def transposed(self) -> "Csr":
        order = np.argsort(self.columns, kind="stable")
        starts = np.zeros(self.width + 1, dtype=np.int64)
        np.cumsum(np.bincount(self.columns, minlength=self.width), out=starts[1:])
        return Csr(starts, np.repeat(np.arange(len(self)), np.diff(self.starts))[order], len(self))

    def product_sizes(self, other: "Csr") -> np.ndarray:
        """Entries that each row of the product is added up from."""
        sums = np.zeros(len(self.columns) + 1, dtype=np.int64)
        np.cumsum(np.diff(other.starts)[self.columns], out=sums[1:])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def product(self, other: "Csr") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, columns, values) of ``self x other``, in bounded ranges of rows."""
        sizes = np.cumsum(self.product_sizes(other))
        first = 0
        while first < len(self):
            done = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, done + PRODUCT_ENTRIES, side="right")))
            named = self.columns[self.starts[first] : self.starts[last]]
            rows = np.repeat(np.arange(first, last), np.diff(self.starts[first : last + 1]))
            begin, count = other.starts[named], other.starts[named + 1] - other.starts[named]
            shift = np.repeat(begin - np.cumsum(count) + count, count)
            columns = other.columns[shift + np.arange(len(shift))]
            keys = np.repeat(rows, count) * other.width + columns
            if (keys[1:] < keys[:-1]).any():
                keys.sort()
            new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
            values = np.diff(np.append(new, len(keys)))
            yield keys[new] // other.width, keys[new] % other.width, values
            first = last


# -- tokenizers ---------------------------------------------------------------


def _byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 ones for themselves, others from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


@dataclass
class Vocabulary:
    """The bytes of each id, end to end."""

    data: np.ndarray
    starts: np.ndarray
    decimal: np.ndarray = field(repr=False)  # "id", "id,", "id|" and "id;"

    @classmethod
    def of(cls, tokens: dict[int, bytes]) -> "Vocabulary":
        found = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        starts = np.concatenate([[0], np.cumsum([len(t) for t in found])])
        decimal = np.array([[f"{i}{mark}" for i in range(len(found))] for mark in ("", ",", "|", ";")], dtype=object)
        return cls(np.frombuffer(b"".join(found), dtype=np.uint8), starts, decimal)

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        return self.starts[ids + 1] - self.starts[ids]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        sizes = self.lengths(ids)
        shift = np.repeat(self.starts[ids] - np.cumsum(sizes) + sizes, sizes)
        return self.data[shift + np.arange(len(shift))]


#: Fixed value: how byte-level vocabularies cut a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _byte_bpe(content: bytes):
    """(texts -> lists of ids, vocabulary) of a byte-level BPE file.

    Where ids follow the merges, ``tiktoken`` gives the same ids in a quarter of
    the time; any other file is read by ``tokenizers``.
    """
    told = json.loads(content)
    codes = _byte_characters()
    vocabulary = told["model"]["vocab"]
    tokens = {i: bytes(codes[c] for c in t) for t, i in vocabulary.items() if all(c in codes for c in t)}
    merged = ("".join(m) if isinstance(m, list) else m.replace(" ", "") for m in told["model"]["merges"])
    words = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    plain = (
        words.items() <= (told["pre_tokenizer"] or {}).items()
        and told["normalizer"] is None
        and not any(told["model"].get(k) for k in ("dropout", "unk_token", "end_of_word_suffix", "ignore_merges"))
        and all(vocabulary[t] == 256 + i for i, t in enumerate(merged))
    )
    if plain:
        import tiktoken

        ranks = {t: i for i, t in tokens.items()}
        encoding = tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        return (lambda texts: [encoding.encode_ordinary(t) for t in texts]), Vocabulary.of(tokens)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark shares out the work
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content.decode())
    tokenizer.encode_special_tokens = True
    return (lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]), Vocabulary.of(tokens)


@lru_cache(maxsize=2)
def _piece_bpe(content: bytes):
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_proto=content)
    tokens = {}
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        code = re.fullmatch("<0x([0-9A-Fa-f]{2})>", piece) if processor.is_byte(i) else None
        tokens[i] = bytes([int(code[1], 16)]) if code else piece.replace("▁", " ").encode()
    return processor, Vocabulary.of(tokens)


@dataclass
class Tokenizers:
    """Contents of the two tokenizers' files."""

    first: bytes
    second: bytes

    @classmethod
    def read(cls, first: str = BYTE_BPE, second: str = PIECE_BPE) -> "Tokenizers":
        with open(first, "rb") as a, open(second, "rb") as b:
            return cls(a.read(), b.read())


class Alignment:
    """Tokens of some texts by both tokenizers, where both give the texts back; bytes are numbered over all texts."""

    def __init__(self, texts: list[str], tokenizers: Tokenizers):
        first, self.vocabulary_a = _byte_bpe(tokenizers.first)
        second, self.vocabulary_b = _piece_bpe(tokenizers.second)
        filled = [i for i, t in enumerate(texts) if t]
        whole = [" " + texts[i] for i in filled]
        ids_a = first(whole)
        ids_b = second.encode([texts[i] for i in filled], num_threads=1) if filled else []
        # which texts come back, byte for byte
        data = [w.encode() for w in whole]
        good = np.ones(len(filled), dtype=bool)
        for ids, vocabulary in ((ids_a, self.vocabulary_a), (ids_b, self.vocabulary_b)):
            flat, counts = _flat(ids)
            sizes = np.add.reduceat(np.append(vocabulary.lengths(flat), 0), _before(counts)) if len(counts) else counts
            good &= (counts > 0) & (sizes == [len(d) for d in data])
        use = np.flatnonzero(good)
        for ids, vocabulary in ((ids_a, self.vocabulary_a), (ids_b, self.vocabulary_b)):
            joined = vocabulary.joined(_flat([ids[i] for i in use])[0])
            same = joined == np.frombuffer(b"".join(data[i] for i in use), dtype=np.uint8)
            ends = np.cumsum([len(data[i]) for i in use])
            wrong = np.searchsorted(ends, np.flatnonzero(~same), side="right")
            good[use[wrong]] = False
        use = np.flatnonzero(good)
        self.texts = np.array(filled, dtype=np.int64)[use]  # numbers of the texts with tokens
        self.n_texts = len(texts)
        self.a, counts_a = _flat([ids_a[i] for i in use])
        self.b, counts_b = _flat([ids_b[i] for i in use])
        self.text_a, self.text_b = np.repeat(self.texts, counts_a), np.repeat(self.texts, counts_b)
        self.ends_a = np.cumsum(self.vocabulary_a.lengths(self.a))
        self.ends_b = np.cumsum(self.vocabulary_b.lengths(self.b))
        self.bytes = int(self.ends_a[-1]) if len(self.a) else 0

    @cached_property
    def cuts(self) -> np.ndarray:
        """Byte offsets at which tokens of both end."""
        return np.intersect1d(self.ends_a, self.ends_b, assume_unique=True)

    @cached_property
    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The group of each token."""
        return np.searchsorted(self.cuts, self.ends_a), np.searchsorted(self.cuts, self.ends_b)

    def by_bytes(self) -> tuple[Csr, Csr]:
        """Token x byte, and byte x token."""
        return Csr.partition(self.ends_a, self.bytes), Csr.partition(self.ends_b, self.bytes).transposed()

    def by_groups(self) -> tuple[Csr, Csr]:
        """Token x group, and group x token."""
        a, b = (Csr.one_each(g, len(self.cuts)) for g in self.groups)
        return a, b.transposed()

    def per_text(self, texts: np.ndarray) -> np.ndarray:
        return np.bincount(texts, minlength=self.n_texts)

    def group_texts(self) -> list[str]:
        """Per text its groups as ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
        group_a, group_b = self.groups
        n = len(self.cuts)
        before_a = np.concatenate([[0], np.cumsum(np.bincount(group_a, minlength=n))])
        before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=n))])
        mark_a, mark_b = np.ones(len(self.a), dtype=np.int64), np.ones(len(self.b), dtype=np.int64)
        mark_a[before_a[1:] - 1], mark_b[before_b[1:] - 1] = 2, 3
        last = np.searchsorted(self.text_b, np.append(self.texts, self.n_texts))[1:] - 1
        mark_b[last] = 0
        parts = np.empty(len(self.a) + len(self.b), dtype=object)
        parts[np.arange(len(self.a)) + before_b[group_a]] = self.vocabulary_a.decimal[mark_a, self.a]
        parts[np.arange(len(self.b)) + before_a[group_b + 1]] = self.vocabulary_b.decimal[mark_b, self.b]
        ends = np.cumsum(self.per_text(self.text_a) + self.per_text(self.text_b))
        return ["".join(parts[a:b]) for a, b in zip([0, *ends[:-1]], ends)]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(i) for i in ids], dtype=np.int64)
    return np.fromiter((x for i in ids for x in i), dtype=np.int64, count=int(counts.sum())), counts


def _before(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _alignments(batch: pa.RecordBatch, tokenizers: Tokenizers) -> Iterator[tuple[pa.Array, Alignment]]:
    """Ids and alignment of each block of (id, text)."""
    for block in blocks(batch.column(1)):
        rows = batch.slice(block.first, len(block))
        yield rows.column(0), Alignment(rows.column(1).to_pylist(), tokenizers)


# -- Spark --------------------------------------------------------------------


def token_links(
    docs: DataFrame, tokenizers: Tokenizers, kind: str = "overlap", id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, a_at, b_at, a_id, b_id, weight): links of token occurrences, numbered in their text.

    ``kind`` is "overlap" (weight: bytes shared) or "group" (weight 1).
    """
    if kind not in ("overlap", "group"):
        raise ValueError(f"kind is overlap or group, not {kind!r}")
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)
    id_type = docs.schema[id_column].dataType.simpleString()
    names = [id_column, "a_at", "b_at", "a_id", "b_id", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, found in _alignments(batch, shared.value):
                before_a, before_b = (_before(found.per_text(t)) for t in (found.text_a, found.text_b))
                left, right = found.by_bytes() if kind == "overlap" else found.by_groups()
                for a, b, weight in left.product(right):
                    text = found.text_a[a]
                    columns = [a - before_a[text], b - before_b[text], found.a[a], found.b[b], weight]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(text)), *map(pa.array, columns)], names=names)

    schema = f"`{id_column}` {id_type}, a_at bigint, b_at bigint, a_id bigint, b_id bigint, weight bigint"
    return docs.select(id_column, text_column).mapInArrow(run, schema)


def _packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers as steps, low bytes first, so that the many zero bytes stand together."""
    return np.diff(numbers, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(packed, dtype=np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)
    return np.cumsum(steps.astype(np.int64))


_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_group_links")


def _chunks(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """Per text its counts, and its pairs and how often it has each, as numbers in its chunk.

    The first row of a chunk also has its distinct pairs, most frequent first, and
    how many of its documents hold each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)
    kind = docs.schema["id"].dataType.simpleString()
    names = ["chunk", "id", *_COUNTS, "groups_sha256", "own", "times", "pairs", "held"]
    schema = f"chunk bigint, id {kind}, {', '.join(f'{c} bigint' for c in _COUNTS)}, groups_sha256 string, own binary, times binary, "
    schema += "pairs array<bigint>, held array<bigint>"

    def measured(ids: pa.Array, found: Alignment) -> tuple[int, pa.Array, list, list, np.ndarray, np.ndarray, np.ndarray]:
        """Counts and digests of a block's texts, and (text, pair, times) sorted by both."""
        left, right = found.by_bytes()
        keys = [np.zeros(0, dtype=np.int64)]
        links = np.zeros(found.n_texts, dtype=np.int64)
        for a, b, _ in left.product(right):
            links += found.per_text(found.text_a[a])
            keys.append((found.text_a[a] << (2 * ID_BITS)) | (found.a[a] << ID_BITS) | found.b[b])
        keys = np.sort(np.concatenate(keys))
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
        times = np.diff(np.append(new, len(keys)))
        keys = keys[new]
        left, right = found.by_groups()
        group_links = np.bincount(found.text_a, left.product_sizes(right), minlength=found.n_texts).astype(np.int64)
        groups = found.per_text(found.text_a[np.searchsorted(found.ends_a, found.cuts)])
        counts = [found.per_text(found.text_a), found.per_text(found.text_b), groups, links, group_links]
        digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in found.group_texts()]
        return found.bytes, ids, counts, digests, keys >> (2 * ID_BITS), keys & ((1 << (2 * ID_BITS)) - 1), times

    def chunk_rows(chunk: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        distinct, number, held = np.unique(np.concatenate([p[5] for p in parts]), return_inverse=True, return_counts=True)
        order = np.argsort(-held, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        number = place[number]
        done = 0
        for k, (_, ids, counts, digests, text, _, times) in enumerate(parts):
            mine = number[done : done + len(text)]
            done += len(text)
            again = np.lexsort((mine, text))
            ends = np.searchsorted(text, np.arange(len(ids) + 1))
            rows = [again[a:b] for a, b in zip(ends[:-1], ends[1:])]
            pairs = [distinct[order] if not k and not i else None for i in range(len(ids))]
            held_by = [held[order] if not k and not i else None for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(ids), chunk)),
                    ids,
                    *(pa.array(c.astype(np.int64)) for c in counts),
                    pa.array(digests, pa.string()),
                    pa.array([_packed(mine[r]) for r in rows], pa.binary()),
                    pa.array([_packed(np.cumsum(times[r])) for r in rows], pa.binary()),
                    pa.array(pairs, pa.list_(pa.int64())),
                    pa.array(held_by, pa.list_(pa.int64())),
                ],
                names=names,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, parts = TaskContext.get().partitionId() << 40, []
        for batch in batches:
            for ids, found in _alignments(batch, shared.value):
                parts.append(measured(ids, found))
                if sum(p[0] for p in parts) >= CHUNK_BYTES:
                    yield from chunk_rows(chunk, parts)
                    chunk, parts = chunk + 1, []
        if parts:
            yield from chunk_rows(chunk, parts)

    return docs.mapInArrow(run, schema)


def align(docs: DataFrame, tokenizers: Tokenizers, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: numbers of tokens (n_a, n_b), groups and links of both kinds, digest of the groups, and over its
    overlap links n_best (links whose pair's count is the highest of their first id's pairs) and count_sum.

    A pair's count is the number of documents that hold it linked.
    """
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = written(_chunks(docs, tokenizers), "aligned")
    zipped = F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "p")
    in_chunks = rows.where("pairs is not null").select(F.col("chunk").alias("of"), zipped).select("of", "at", F.col("p.pairs").alias("pair"), "p.held")
    counts = written(in_chunks.groupBy("pair").agg(F.sum("held").alias("n")), "pair-counts")
    first = F.shiftright("pair", ID_BITS).alias("a")
    highest = counts.groupBy(first).agg(F.max("n").alias("top"))  # a row for each id of the first tokenizer at most
    counts = counts.withColumn("a", first).join(highest, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    known = in_chunks.join(counts, "pair").select("of", "at", "n", "best")

    names = ["id", *_COUNTS, "groups_sha256"]

    def run(key: tuple, texts: pa.Table, pairs: pa.Table) -> pa.Table:
        at = pairs["at"].to_numpy()
        n, best = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        n[at], best[at] = pairs["n"].to_numpy(), pairs["best"].to_numpy()
        n_best, count_sum = [], []
        for own, times in zip(texts["own"].to_pylist(), texts["times"].to_pylist()):
            mine, often = _unpacked(own), np.diff(_unpacked(times), prepend=0)
            n_best.append(int(best[mine] @ often))
            count_sum.append(int(n[mine] @ often))
        out = texts.select(names)
        return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, {', '.join(f'{c} bigint' for c in _COUNTS)}, groups_sha256 string, n_best bigint, count_sum bigint"
    left = rows.select("chunk", *names, "own", "times").groupBy("chunk")
    return left.cogroup(known.groupBy("of")).applyInArrow(run, schema).withColumnRenamed("id", id_column)
