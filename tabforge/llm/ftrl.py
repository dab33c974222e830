"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams (operator 3).

Features of a text are the distinct hashes of its words, of their beginnings (inflected forms share them), of
neighbouring pairs and of pairs with one word between them. Training takes a bounded sample of the labelled rows (``TRAIN_ROWS``, by hash of the id): their
features are made in parallel and one task runs the online updates, with per-coordinate learning rates and L1
sparsity. What comes back are the non-zero weights, at most ``BUCKETS`` of them (12 MB), which is what makes
them safe to broadcast. Scoring is one pass over all rows without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import ALNUM, LOWER, buffers, distinct, hasher, pieces, words
from .common import row_key, workers

TRAIN_ROWS = 12_000
BUCKETS = 1 << 20
EPOCHS = 3
#: Lengths in bytes of the word beginnings.
BEGINNINGS = (4, 5)
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.0


def _hashed(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature number) of every word, word beginning, pair and skip-pair, with repeats."""
    low = LOWER[raw]
    s, e, doc = words(low, off, ALNUM)
    of = hasher(low)
    h = of(s, e)
    parts, docs = [h], [doc]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            parts.append((h[:-gap] * np.uint64(salt) ^ (h[gap:] + np.uint64(salt)))[same])
            docs.append(doc[gap:][same])
    for length in BEGINNINGS:
        long = e - s > length
        parts.append(of(s[long], s[long] + length) + np.uint64(length))
        docs.append(doc[long])
    bucket = (np.concatenate(parts) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)
    return np.concatenate(docs), bucket.astype(np.int64)


def _by_document(doc: np.ndarray, feature: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs, ascending."""
    key = distinct((doc.astype(np.int64) << 20) | feature)
    return key >> 20, key & (BUCKETS - 1)


def grams(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """For each document its sorted distinct feature numbers."""
    n = len(off) - 1
    doc, feature = _by_document(*_hashed(raw, off), n)
    cut = np.searchsorted(doc, np.arange(n + 1))
    feature = feature.astype(np.int32)
    return [feature[cut[i]:cut[i + 1]] for i in range(n)]


def margins(raw: np.ndarray, off: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of the weights of each document's distinct features; those of weight zero are left out first."""
    n = len(off) - 1
    doc, feature = _hashed(raw, off)
    keep = w[feature] != 0
    doc, feature = _by_document(doc[keep], feature[keep], n)
    return np.bincount(doc, weights=w[feature], minlength=n) + w[BUCKETS]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = buffers(batch.column("text"))
        got = [f for _, _, r, o in pieces(raw, off) for f in grams(r, o)]
        yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("label"),
                                          pa.array(got, pa.list_(pa.int32()))], names=["at", "label", "features"])


class Ftrl:
    """Per-coordinate FTRL-proximal state; weights are computed when they are needed."""

    def __init__(self, buckets: int = BUCKETS):
        self.z, self.n = np.zeros(buckets + 1), np.zeros(buckets + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        rate = (BETA + np.sqrt(self.n[at])) / ALPHA + L2
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / rate, 0.0)

    def learn(self, at: np.ndarray, y: float) -> None:
        """One logistic update of the coordinates of a document (its last is the constant)."""
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] += g * g


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The online updates over the bounded sample, which arrives in one task, in the order of its hash."""
    docs, y = [], []
    for batch in batches:
        col = batch.column("features")
        flat, off = col.flatten().to_numpy(), col.offsets.to_numpy()
        off = off - off[0]
        docs += [np.append(flat[off[i]:off[i + 1]], BUCKETS) for i in range(len(col))]
        y += batch.column("label").to_pylist()
    model = Ftrl()
    for _ in range(EPOCHS):
        for at, label in zip(docs, y):
            model.learn(at, float(label))
    at = np.arange(BUCKETS + 1)
    w = model.weights(at)
    keep = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array([keep.astype(np.int32)], pa.list_(pa.int32())),
                                      pa.array([w[keep].astype(np.float64)], pa.list_(pa.float64()))], names=["at", "w"])


def labelled(documents: DataFrame, labels: DataFrame, label: str, usable, bound: int) -> DataFrame:
    """(at, label, text) of at most ``bound`` labelled ids for which ``usable`` holds, by hash of the id; one row an id.

    Of an id with several labels the largest counts, of one with several texts that of the least hash (NULL texts
    are empty), so repeated ids and copies of label rows take no more than one place of the sample.
    """
    some = (labels.select("doc_id", F.col(label).alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
            .where(usable).groupBy("doc_id").agg(F.max("label").alias("label"))
            .withColumn("at", F.xxhash64("doc_id", F.lit(17))).orderBy("at", "doc_id").limit(bound))
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    return (texts.groupBy("doc_id", "at", "label").agg(F.min(F.struct(F.xxhash64("text").alias("th"), "text")).alias("t"))
            .select("at", "label", "t.text"))


def fit(documents: DataFrame, labels: DataFrame, usable) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and weights; without labelled rows there are none and every score is one half."""
    workers(documents.sparkSession)
    rows = (labelled(documents, labels, "toxic", usable, TRAIN_ROWS).select("at", "label", "text")
            .mapInArrow(_features, "at long, label int, features array<int>")
            .repartition(1).sortWithinPartitions("at", "label", F.xxhash64("features"))
            .mapInArrow(_train, "at array<int>, w array<double>").collect())
    at = np.array(rows[0]["at"] if rows else [], np.int64)
    return at, np.array(rows[0]["w"] if rows else [], float)


def score_toxicity(documents: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, score, predicted) of every row; NULL and empty texts score by the constant alone.

    Repeated rows are scored alike, other columns are ignored, and an empty table gives no rows.
    """
    spark = documents.sparkSession
    workers(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        w = np.zeros(BUCKETS + 1)
        w[shared.value[0]] = shared.value[1]
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            z = np.concatenate([np.zeros(0), *(margins(r, o, w) for _, _, r, o in pieces(raw, off))])
            score = 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()),
                                              pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): labels of the rows with crc32(doc_id) mod 5 = 0 are not learnt from."""
    model = fit(documents, labels, row_key() % 5 != 0)
    return score_toxicity(documents, model).select("doc_id", (row_key() % 5 == 0).alias("held_out"), "score", "predicted")
