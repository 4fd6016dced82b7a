"""Document quality by attention over passages (multiple-instance learning).

A text is a bag of passages of ``PASSAGE`` words. Each passage is encoded from
measures of its form and repetition; gated attention, learned from document
labels alone, weighs the passages; the weighted mean gives the document's score.

Training uses all documents of a label up to ``SAMPLE_DOCS``, about that many of a
more frequent label, drawn by a hash of the id: that bounds what the driver trains
on. All passages of these documents are learned from. Each document counts for as many as its label's draw stands for,
so rare labels are learned and their share stays. Scoring reads all passages of all texts,
in one pass without a shuffle.

Edge cases: a null, empty or blank text is a bag of one empty passage and gets a
score like any other. Without labels of both kinds the score is the share of
label 1 (0.5 without labels). Repeated rows get equal scores. An empty table
gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.tables import written
from hearsay.llm.textblocks import Block, blocks, repeated

PASSAGE = 64
SAMPLE_DOCS = 3_000
HIDDEN, ATTENTION = 16, 12
ROUNDS, STEP, DECAY = 200, 0.03, 1e-4
SEED = 11

_CLASSES = {
    "symbol": b"#*$%&<>~^=_@{}[]\\",
    "bar": b"|",
    "shout": b"!?",
    "stop": b".,;:",
    "digit": b"0123456789",
    "upper": bytes(range(ord("A"), ord("Z") + 1)),
    "lower": bytes(range(ord("a"), ord("z") + 1)),
    "newline": b"\n",
}
_TABLE = np.zeros((len(_CLASSES), 256), dtype=bool)
for _i, _bytes in enumerate(_CLASSES.values()):
    _TABLE[_i, list(_bytes)] = True
N_FEATURES = len(_CLASSES) + 9


def encode(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Row and measures of each passage; a text without words is one passage of zeros."""
    counts = np.diff(block.words_before)
    passages = np.maximum(1, -(-counts // PASSAGE))
    rows = np.repeat(np.arange(len(block)), passages)
    first = np.concatenate([[0], np.cumsum(passages)])[:-1]
    starts, ends = block.bounds
    inside = np.arange(len(starts)) - block.words_before[block.word_rows]
    which = first[block.word_rows] + inside // PASSAGE  # passage of each word
    n = len(rows)
    words = np.bincount(which, minlength=n).astype(float)
    lead = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    chars = lead[ends] - lead[starts]
    total = np.bincount(which, weights=chars, minlength=n)
    out = np.zeros((n, N_FEATURES))
    # a word's bytes and what follows it up to the next word of the text belong to its passage
    upto = np.append(starts[1:], len(block.data)) if len(starts) else starts
    if len(starts):
        upto = np.minimum(upto, block.offsets[block.word_rows + 1])
    for i in range(len(_CLASSES)):
        sums = np.concatenate([[0], np.cumsum(_TABLE[i][block.data])])
        out[:, i] = np.bincount(which, weights=sums[upto] - sums[starts], minlength=n) / np.maximum(total, 1)
    again = repeated(which, block.words)
    at, grams = block.ngrams(3)
    twice = np.zeros(len(starts) + 1)
    hit = at[repeated(block.word_rows[at], grams)]
    np.add.at(twice, hit, 1)
    np.add.at(twice, np.minimum(hit + 3, len(starts)), -1)
    per_word = (
        chars / 10.0,
        (chars / 10.0) ** 2 / 4,
        chars <= 2,
        chars >= 13,
        again,
        np.cumsum(twice)[:-1] > 0,
        (ends - starts) > chars,
    )
    for k, values in enumerate(per_word):
        out[:, len(_CLASSES) + k] = np.bincount(which, weights=values.astype(float), minlength=n) / np.maximum(words, 1)
    out[:, -2] = words / PASSAGE
    out[:, -1] = np.log1p(passages[rows]) / 5
    return rows, out


class Model:
    """tanh encoder, gated attention and a logistic head; all parameters in one dict."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray]):
        self.mean, self.scale, self.weights = mean, scale, weights

    @classmethod
    def fresh(cls, x: np.ndarray) -> Model:
        rng = np.random.default_rng(SEED)
        shape = {"w": (N_FEATURES, HIDDEN), "v": (HIDDEN, ATTENTION), "u": (HIDDEN, ATTENTION)}
        weights = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shape.items()}
        weights |= {"b": np.zeros(HIDDEN), "a": rng.normal(0, 0.1, ATTENTION), "c": np.zeros(HIDDEN), "d": np.zeros(1)}
        return cls(x.mean(axis=0), x.std(axis=0) + 1e-3, weights)

    def forward(self, x: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
        """``begin``: first passage of each bag; no bag is empty."""
        p = self.weights
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        bag = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(x))))
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, begin)[bag])
        share = e / np.add.reduceat(e, begin)[bag]
        z = np.add.reduceat(share[:, None] * h, begin)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"x": x, "bag": bag, "h": h, "t": t, "g": g, "share": share, "z": z, "score": score}

    def slopes(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.weights, self.forward(x, begin)
        bag, h, t, g, share = f["bag"], f["h"], f["t"], f["g"], f["share"]
        err = (f["score"] - y) * weight / weight.sum()
        dz = err[:, None] * p["c"]
        d_share = (dz[bag] * h).sum(axis=1)
        de = share * (d_share - np.add.reduceat(share * d_share, begin)[bag])
        dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
        dh = (share[:, None] * dz[bag] + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
        out = {"c": f["z"].T @ err, "d": np.array([err.sum()]), "a": (t * g).T @ de, "v": h.T @ dt, "u": h.T @ dg}
        out |= {"w": f["x"].T @ dh, "b": dh.sum(axis=0)}
        return {k: v + DECAY * p[k] for k, v in out.items()}

    def fit(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for r in range(1, ROUNDS + 1):
            for k, slope in self.slopes(x, begin, y, weight).items():
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                self.weights[k] = self.weights[k] - STEP * (first[k] / (1 - 0.9**r)) / (
                    np.sqrt(second[k] / (1 - 0.999**r)) + 1e-8
                )
        return self


def _sample(known: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """Of the (id, y) rows, all of each label up to ``most``, else about so many by a hash of the id; and all rows' number by label."""
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    place, some = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 40)), F.lit(True)
    for y, n in counts.items():
        if n > most:
            some = F.when(F.col("y") == y, place < (most << 40) // n).otherwise(some)
    return known.where(some), counts


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    sample_docs: int = SAMPLE_DOCS,
) -> Model | float:
    """The trained model, or the share of label 1 if there is only one kind of label."""
    known = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
    known = known.groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).cast("int").alias("y"))
    some, counts = _sample(written(known, "all-labels"), sample_docs)
    known = written(some, "labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                rows, x = encode(block)
                ends = np.searchsorted(rows, np.arange(len(block) + 1))
                bags = [x[a:b].astype(np.float32).tobytes() for a, b in zip(ends[:-1], ends[1:])]
                here = slice(block.first, block.first + len(block))
                columns = [batch.column(i)[here] for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bags, pa.binary())], names=["id", "y", "bag"])

    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(known, "id")
    kind = known.schema["id"].dataType.simpleString()
    rows = texts.select("id", "y", "text").mapInArrow(run, f"id {kind}, y int, bag binary").collect()
    rows.sort(key=lambda r: (str(r.id), r.bag))
    y = np.array([r.y for r in rows], dtype=float)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    kinds, which, drawn = np.unique(y, return_inverse=True, return_counts=True)
    stands_for = np.array([counts[int(k)] if counts[int(k)] > sample_docs else n for k, n in zip(kinds, drawn)]) / drawn
    bags = [np.frombuffer(r.bag, dtype=np.float32).reshape(-1, N_FEATURES) for r in rows]
    x = np.concatenate(bags).astype(float)
    begin = np.concatenate([[0], np.cumsum([len(b) for b in bags])])[:-1]
    return Model.fresh(x).fit(x, begin, y, stands_for[which])


def score(docs: DataFrame, model: Model | float, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) of every row."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0)]
            for block in blocks(batch.column(1)):
                if isinstance(model, float):
                    parts.append(np.full(len(block), model))
                else:
                    rows, x = encode(block)
                    parts.append(model.forward(x, np.searchsorted(rows, np.arange(len(block))))["score"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts))], names=[id_column, "score"])

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, score double")
