"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are hashes of its words, word pairs, word shapes, shape pairs and shape
triples (a shape keeps the case and the symbols of a word, and says whether it repeats the word
before), each with its count over the number of words. A score is the sparse dot product of
these with the weights. Training takes at most `most` labelled texts (a documented bound),
in SHARDS groups that are trained apart and whose weights are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascape.llm.common import in_small_batches, labelled_sample, with_columns, written
from terrascape.llm.textops import Texts, mix, windows

BUCKETS = 1 << 18
MOST_LABELLED = 12_000
SCALE = 30.0
#: Models that are trained apart and averaged: one, as the labelled texts are bounded; more let a larger bound train in parallel.
SHARDS = 1


def features(texts: list[bytes | None], buckets: int = BUCKETS) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Per family of features the (bucket, text) of each occurrence; the number of words of each text."""
    words = Texts(texts).words()
    h, shape = words.hashes(), words.shape_hashes()
    if len(h):
        shape[1:] ^= np.where(h[1:] == h[:-1], np.uint64(0x5851F42D4C957F2D), np.uint64(0))
    mask = np.uint64(buckets - 1)
    found = []
    for salt, (hashes, k) in enumerate(((h, 1), (h, 2), (shape, 1), (shape, 2), (shape, 3)), 1):
        w = windows(hashes, k)
        inside = words.text[: len(w)] == words.text[k - 1 : k - 1 + len(w)]
        index = ((mix(w + np.uint64(salt)) >> np.uint64(20)) & mask).astype(np.int32)
        found.append((index[inside], words.text[: len(w)][inside]))
    return found, words.count


def scores(texts: list[bytes | None], weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 for each text; an empty text has the bias alone."""
    found, count = features(texts, len(weights))
    z = np.zeros(len(count))
    for index, text in found:
        z += np.bincount(text, weights[index], len(count))
    z = bias + SCALE * z / np.maximum(count, 1)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Ftrl:
    """Follow the regularised leader, per coordinate; the bias is coordinate 0 of its own arrays and isn't regularised."""

    def __init__(self, buckets: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.05):
        self.z, self.n = np.zeros(buckets + 1), np.zeros(buckets + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, at: np.ndarray, x: np.ndarray, y: int, weight: float = 1.0) -> None:
        w = self.weights(at)
        self.add(at, w, weight * (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x)

    def add(self, at: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def sparse(texts: list[bytes | None], buckets: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Each text's distinct buckets, how often it has each, and its number of words."""
    found, count = features(texts, buckets)
    index = np.concatenate([i for i, _ in found])
    text = np.concatenate([t for _, t in found])
    key, n = np.unique(text * np.int64(buckets) + index, return_counts=True)
    cut = np.searchsorted(key, np.arange(len(count) + 1) * np.int64(buckets))
    at, n = (key % buckets).astype(np.int32), n.astype(np.int32)
    return *([x[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)] for x in (at, n)), count


class Rows:
    """(buckets, values, label) of texts in the order of doc_id, as often as asked; the last bucket is the bias.

    Held are buckets and counts, these in as few bytes as they take; values are worked out a text at a time.
    """

    def __init__(self, batches: Iterator[pa.RecordBatch], buckets: int):
        self.buckets, held = buckets, []
        for batch in batches:
            at, n = (packed(batch.column(c)) for c in ("at", "n"))
            held += zip(batch.column("doc_id").to_pylist(), at, n, batch.column("words").to_pylist(), batch.column("label").to_pylist(), strict=True)
        self.held = sorted(held, key=lambda row: row[0])

    def __len__(self) -> int:
        return len(self.held)

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        for _, at, n, words, y in self.held:
            yield np.append(at, np.int32(self.buckets)), np.append(SCALE * n.astype(np.float64) / max(1, words), 1.0), y


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]] | Rows, buckets: int, state: Ftrl | None = None, epochs: int = 2) -> Ftrl:
    """Passes over (buckets, values, label); the rarer label weighs more, up to four times."""
    model = state or Ftrl(buckets)
    ones = sum(y for _, _, y in rows)
    rare = [min(4.0, max(1.0, len(rows) / (2 * max(1, c)))) for c in (len(rows) - ones, ones)]
    for _ in range(epochs):
        for at, x, y in rows:
            model.step(at, x, y, rare[y])
    return model


def packed(column: pa.Array) -> list[np.ndarray]:
    """A column of lists of numbers from 0 on as numpy arrays in memory of their own, of the narrowest type that holds them all."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    flat = flat.astype(np.min_scalar_type(flat.max(initial=0)))
    cut = column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def averaged(rows: DataFrame, learn, buckets: int) -> tuple[np.ndarray, float]:
    """Weights and bias: the mean of the models that learn(batches) fits to each shard of rows, by their numbers of texts.

    rows: a bounded training set with a number `deal` by which it is dealt to the shards; batches: those
    of a shard, in any order and one at a time. learn returns the model and the number of texts it saw.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, texts = learn(batches)
        if texts:
            w = model.weights()
            at = np.flatnonzero(w).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, np.int32(-1))), pa.array(np.append(texts * w[at], float(texts)))], names=["at", "w"])

    parts = in_small_batches(rows).withColumn("shard", F.pmod("deal", F.lit(SHARDS).cast("long"))).groupBy("shard")
    found = parts.applyInArrow(run, "at int, w double").groupBy("at").agg(F.sum("w").alias("w")).toPandas().set_index("at")["w"]
    out = np.zeros(buckets + 1)
    if len(found):
        n = found.pop(-1)
        out[found.index.to_numpy()] = found.to_numpy() / n
    return out[:-1].astype(np.float32), float(out[-1])


def trained(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, buckets: int = BUCKETS) -> tuple[np.ndarray, float]:
    """Weights and bias, learned from at most `most` rows of labels(doc_id, quality) that aren't held out.

    Without a labelled text the weights are 0 and every score is 0.5.
    """
    sample = documents.select("doc_id", "text").join(F.broadcast(labelled_sample(labels, "quality", most)), "doc_id")

    rows = written(with_columns(sample, "at array<int>, n array<int>, words int", lambda texts: sparse(texts, buckets)).drop("text"), "quality-sample")
    return averaged(rows.withColumn("deal", F.xxhash64("doc_id")), lambda batches: learned(batches, buckets), buckets)


def learned(batches: Iterator[pa.RecordBatch], buckets: int) -> tuple[Ftrl, int]:
    """The model of a shard's rows (doc_id, label, at, n, words), and how many there are."""
    rows = Rows(batches, buckets)
    return fit(rows, buckets), len(rows)


def classify(documents: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.5) -> DataFrame:
    """documents with score double (0 to 1, higher: good quality likelier) and predicted int (1 if score >= threshold).

    A null or empty text is scored by the bias alone; equal texts score alike; rows are neither
    dropped nor merged, whatever doc_id holds; columns named score or predicted are replaced.
    """
    weights = documents.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list[bytes | None]):
        score = scores(texts, *weights.value)
        return score, (score >= threshold).astype(np.int32)

    return with_columns(documents, "score double, predicted int", compute)
