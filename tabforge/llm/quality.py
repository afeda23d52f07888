"""Operator 3, quality classifier: hashed word and character n-gram vectors, averaged per document, with a softmax output.

The vectors are learned by stochastic gradient descent in numpy on a bounded sample of labelled rows (`rows_per_class`,
`max_bytes`); scoring covers every whole text. Features of a text are its words, its pairs of neighbouring words and all
runs of three bytes, case kept, each hashed to one of `2**BITS` vectors; a word that follows itself is one feature,
whatever the word. The sample holds as many rows of either class, so the bias is then moved to the classes' shares among
all labelled rows.

As the output is linear in the average, scoring needs one number per bucket (its vector's share of the margin), so a task
holds 2**BITS floats, whatever the corpus.

Defined cases: a null or empty text has no feature and gets the score of the bias; a text of one word has no pairs;
repeated rows get equal scores; an empty table gives an empty result; without labels of both classes the share of class 1
among the labels (0.5 if none) is every text's score. Only `doc_id` and `text` are read, so further columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import Words, fold, labelled_sample, text_slices

BITS = 17


@dataclass
class QualityModel:
    """share: what each bucket adds to the margin when it is the only feature; bias: the margin without features."""

    share: np.ndarray
    bias: float


def _buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words, word pairs and byte triples, each with the number of its first entry per text (one more at the end)."""
    down = np.uint64(64 - BITS)
    w = Words(texts, lower=False)
    word = ((w.hash * np.uint64(0xD6E8FEB86659FD93)) >> down).astype(np.int32)
    with np.errstate(over="ignore"):
        pair = (((w.hash[:-1] * np.uint64(0xA0761D6478BD642F)) ^ w.hash[1:]) * np.uint64(0xE7037ED1A0B428DB)) >> down if len(w) > 1 else np.zeros(0, np.uint64)
    pair[w.hash[:-1] == w.hash[1:]] = 0  # a word said twice: one feature, whatever the word
    inside = np.ones(len(pair), bool)
    joint = w.first[1:-1] - 1
    inside[joint[(joint >= 0) & (joint < len(pair))]] = False
    pairs = np.concatenate([[0], np.cumsum(inside)])
    pair_first = pairs[np.minimum(w.first, len(pair))]
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8).astype(np.uint32)
    size = np.array([len(x) + 1 for x in texts], np.int64)
    end = np.cumsum(size)
    triple = (raw[:-2] | (raw[1:-1] << np.uint32(8)) | (raw[2:] << np.uint32(16))) if len(raw) > 2 else np.zeros(0, np.uint32)
    triple = (triple * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    inside3 = np.ones(len(triple), bool)
    for back in (1, 2):  # a triple stays within one text and the space after it
        at = end[:-1] - back
        inside3[at[(at >= 0) & (at < len(triple))]] = False
    triples = np.concatenate([[0], np.cumsum(inside3)])
    triple_first = triples[np.minimum(np.concatenate([[0], end]), len(triple))]
    return word, w.first, pair[inside].astype(np.int32), pair_first, triple[inside3].astype(np.int32), triple_first


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each segment; 0 for an empty one."""
    out = np.zeros(len(first) - 1)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[full])
    return out


def score_texts(model: QualityModel, texts: list[bytes]) -> np.ndarray:
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    found = _buckets(texts)
    for bucket, first in zip(found[::2], found[1::2]):
        total += _sums(model.share[bucket], first)
        n += np.diff(first)
    return 1 / (1 + np.exp(-(total / np.maximum(n, 1) + model.bias)))


def fit(sample: list[tuple[bytes, int]], odds: float | None = None, dim: int = 12, epochs: int = 8, rate: float = 0.6, seed: int = 7) -> QualityModel:
    """Stochastic gradient descent, a document a step, with a linearly falling rate. odds: class 1 to class 0 among all labels, if the sample's differ."""
    ys = [y for _, y in sample]
    if len(set(ys)) < 2:
        p = min(max(np.mean(ys), 1e-3), 1 - 1e-3) if ys else 0.5
        return QualityModel(np.zeros(1 << BITS), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    vec = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    out, bias = rng.normal(0, 0.3, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    rows = []
    for text, y in sample:
        found = _buckets([text])
        bucket, n = np.unique(np.concatenate(found[::2]), return_counts=True)
        rows.append((bucket, (n / max(1, n.sum())).astype(np.float32), y))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            bucket, weight, y = rows[i]
            lr = np.float32(rate * (1 - done / steps) + 1e-3)
            mean = weight @ vec[bucket]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= lr * 0.1 * p
            vec[bucket] -= (lr * len(bucket) ** 0.5 * weight)[:, None] * back  # else a long text's vectors hardly move
            done += 1
    return QualityModel((vec @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0] + np.log((odds or sum(ys) / (len(ys) - sum(ys))) / (sum(ys) / (len(ys) - sum(ys))))))


def train_quality(docs: DataFrame, labels: DataFrame, learn=None, rows_per_class: int = 1500, max_bytes: int = 16_000_000) -> QualityModel:
    """Fit on at most rows_per_class labelled documents of each class and max_bytes of text; learn limits the rows by doc_id."""
    learn = F.lit(True) if learn is None else learn
    ones, zeros = labels.where(learn).select(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)).first()
    return fit(labelled_sample(docs, labels, "quality", learn, rows_per_class, max_bytes), ones / zeros if ones and zeros else None)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score of every row; narrow, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score_texts(shared.value, texts))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_quality(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns kept, whose score is least or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, texts in text_slices(batches):
            yield part.filter(pa.array(score_texts(shared.value, texts) >= least))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the rows whose id is not in fold 1 of 3, then scores every row."""
    model = train_quality(docs, labels, fold("doc_id", 3) != 1)
    return score_quality(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
