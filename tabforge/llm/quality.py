"""Quality classifier: ridge on random Fourier features of document statistics (operator 9).

The features approximate a Gaussian kernel over the standardised statistics of ``textstats``. Each partition
of the labelled rows sums its part of the normal equations; the sums meet by matrix row, and only the
``FEATURES`` x ``FEATURES`` system reaches the driver. The ridge scores of a separate share of the labelled
rows are summed into ``GRID`` steps and pooled to a monotone calibration, read by interpolation so that it keeps
the order of the scores. The labelled rows are a bounded sample (``TRAIN_ROWS``, by hash of the id); scoring is one
pass over all rows without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import buffers
from .common import row_key, stash, workers
from .ftrl import labelled
from .textstats import NAMES, doc_stats

TRAIN_ROWS = 20_000
FEATURES, WIDTH, RIDGE, SEED = 256, 5.0, 1e-5, 7
#: Of eight labelled rows one is kept for the calibration.
CALIBRATION = 8
GRID = 1000
THRESHOLD = 0.7


def projection() -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases of the random features; the same in every run."""
    rng = np.random.default_rng(SEED)
    return rng.normal(size=(len(NAMES), FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)


def fourier(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    w, phase = projection()
    z = np.clip((x - mean) / sd, -30, 30)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + phase), np.ones((len(x), 1))])


@dataclass
class Model:
    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def score(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        x = doc_stats(raw, off)
        if not len(self.knots):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(fourier(x, self.mean, self.sd) @ self.weights, self.knots, self.values), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending x: (centre of each pool, its mean), means ascending."""
    pools: list[list[float]] = []
    for a, s, c in zip(x, y, n):
        pools.append([a * c, s, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    p = np.array(pools).reshape(-1, 3)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def _statistics(batches):
    for batch in batches:
        x = doc_stats(*buffers(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("at"), batch.column("label"),
             pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))],
            names=["at", "label", "x"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES))


def fit(documents: DataFrame, labels: DataFrame, usable) -> Model:
    """Without labelled rows every score is one half; where all labels are equal, scores are near that label."""
    spark = documents.sparkSession
    workers(spark)
    rows = stash(labelled(documents, labels, "quality", usable, TRAIN_ROWS).select("at", "label", "text")
                 .mapInArrow(_statistics, "at long, label int, x array<double>"))
    at = [F.col("x")[i] for i in range(len(NAMES))]
    m = rows.agg(F.count("*"), *[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
    none = np.zeros(0)
    if not m[0]:
        return Model(none, none, none, none, none)
    mean = np.array(m[1:1 + len(NAMES)], float)
    sd = np.array(m[1 + len(NAMES):], float) + 1e-6
    kept = F.pmod(F.col("at"), F.lit(CALIBRATION)) == 0

    def normal(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 3))
        for batch in batches:
            p = fourier(_matrix(batch), mean, sd)
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            total += np.hstack([p.T @ p, (p.T @ y)[:, None], np.full((FEATURES + 1, 1), len(y))])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(list(total), pa.list_(pa.float64()))],
                                         names=["i", "row"])

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [part["i"].iloc[0]], "row": [np.sum(np.stack(part["row"].to_numpy()), axis=0)]})

    parts = (rows.where(~kept).mapInArrow(normal, "i long, row array<double>").groupBy("i")
             .applyInPandas(summed, "i long, row array<double>").orderBy("i").collect())
    a = np.array([r["row"] for r in parts])
    n = max(a[0, -1], 1.0) if len(a) else 1.0
    weights = np.linalg.solve(a[:, :-2] / n + RIDGE * np.eye(len(a)), a[:, -2] / n)

    def ridge(batches):
        for batch in batches:
            s = fourier(_matrix(batch), mean, sd) @ weights
            yield pa.RecordBatch.from_arrays([pa.array(np.round(s * GRID).astype(np.int64)), batch.column("label")],
                                             names=["s", "label"])

    held = rows.where(kept)
    steps = (held if held.take(1) else rows).mapInArrow(ridge, "s long, label int").groupBy("s").agg(
        F.count("*").alias("n"), F.sum("label").alias("y")).orderBy("s").collect()
    knots, values = isotonic(*(np.array([r[c] for r in steps], float) / (GRID if c == "s" else 1) for c in ("s", "y", "n")))
    # beyond the outer pools the order goes on: a slope to 0 and 1
    knots = np.concatenate([[knots[0] - 2.0], knots, [knots[-1] + 2.0]])
    values = np.concatenate([[0.0], 0.002 + 0.996 * values, [1.0]])
    return Model(mean, sd, weights, knots, values)


def score_quality(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row; NULL texts count as empty, repeated rows score alike.

    Other columns are ignored; an empty table gives no rows.
    """
    workers(documents.sparkSession)

    def run(batches):
        for batch in batches:
            s = model.score(*buffers(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()),
                                              pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_good(documents: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, that the model predicts to be good."""
    workers(documents.sparkSession)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.score(*buffers(batch.column("text"))) >= THRESHOLD))
    return documents.mapInArrow(run, documents.schema)


#: Folds by crc32(doc_id) mod 4; the one that is held out is never learnt from.
FOLDS, HELD_OUT = 4, 2


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = fit(documents, labels, row_key() % FOLDS != HELD_OUT)
    return score_quality(documents, model).select(
        "doc_id", (row_key() % FOLDS == HELD_OUT).alias("held_out"), "score", "predicted")
