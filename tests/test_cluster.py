"""Clustering plan: the fits of all k and seeds in shared passes are Spark's own, and models share a pass for their silhouettes."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabforge.plans import cluster as C


def features(spark, n=400, parts=3):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 4, (5, 2))[rng.integers(0, 5, n)] + rng.normal(0, 1, (n, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    return df.repartition(parts, "id").select("id", array_to_vector("x").alias("features")).persist()


def test_shared_passes_give_the_fits_of_spark(spark):
    feats = features(spark)
    best = C._best_starts(feats, [2, 5], 3, 42)
    for k in (2, 5):
        fits = [KMeans(k=k, seed=42 + i, maxIter=300, initMode="k-means||", tol=1e-4).fit(feats) for i in range(3)]
        costs = [m.summary.trainingCost for m in fits]
        i, centres, cost = best[k]
        assert cost == pytest.approx(min(costs), rel=1e-9) and costs[i] == pytest.approx(min(costs), rel=1e-9)
        assert np.allclose(centres, fits[i].clusterCenters(), rtol=1e-9, atol=1e-9)
        lab = C._labelled(feats, {"k": centres}).groupBy("k").count().collect()
        assert sorted(map(tuple, lab)) == sorted(map(tuple, fits[i].transform(feats).groupBy("prediction").count().collect()))


def test_k_is_chosen_without_a_fit_by_fit_training(spark, monkeypatch):
    steps, plain = [], KMeans.fit

    def watched(self, df):
        steps.append(self.getMaxIter())
        return plain(self, df)
    monkeypatch.setattr(KMeans, "fit", watched)
    k, table = C.choose_k(features(spark), "id", (2, 4), n_init=2)
    assert steps == [0] * 6 and k in (2, 3, 4)
    assert [r["k"] for r in table.orderBy("k").collect()] == [2, 3, 4]


@pytest.mark.parametrize("twice", [False, True])
def test_models_share_a_pass_of_silhouettes(spark, monkeypatch, twice):
    feats = features(spark, 120).select("id", F.col("features").alias("v"))
    from pyspark.ml.functions import vector_to_array
    df = feats.select("id", vector_to_array("v").alias("x"))
    if twice:
        df = df.unionByName(df.where("id < 3"))
    asked, plain = [], C.silhouettes

    def watched(table, vec, labels, *more):
        asked.append(len(labels))
        return plain(table, vec, labels, *more)
    monkeypatch.setattr(C, "silhouettes", watched)
    res = C.cluster(df, "id", cols=["x"], n_clusters=3, n_init=2, models=("kmeans", "birch", "dbscan"))
    board = {r["model"]: r for r in res.leaderboard.collect()}
    assert all(r["trained_successfully"] for r in board.values())
    scored = [m for m, r in board.items() if r["n_clusters"] >= 2]
    # rows of one id meet each other in the join, differently for each model
    assert asked == ([1] * len(scored) if twice else [len(scored)])
    points = res.extra["features"].select("id", vector_to_array("features").alias("x"))
    for m in scored:
        one = res.labels.where(F.col("model") == m).join(points, "id")
        assert board[m]["silhouette"] == pytest.approx(C.silhouette_for(one, "x", "cluster"), rel=1e-6)
    res.release()
