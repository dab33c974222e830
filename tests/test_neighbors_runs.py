"""Exact neighbour operators against numpy brute force; versions and retention."""

import numpy as np
from pyspark.sql import functions as F

from tabforge.operators import neighbors as NB
from tabforge.sources import runs as RU


def _points(spark, n=120, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.normal(0, 0.3, (n // 2, 2))
    b = rng.normal(5, 0.3, (n // 2 - 5, 2))
    noise = rng.uniform(-10, 15, (5, 2))
    X = np.vstack([a, b, noise])
    rows = [(i, [float(v) for v in X[i]], int(i >= n // 2)) for i in range(len(X))]
    return spark.createDataFrame(rows, "id long, x array<double>, lab int"), X


def test_knn_matches_brute_force(spark):
    df, X = _points(spark)
    nn = NB.knn(df, df.withColumnRenamed("id", "rid"), 4, "id", "rid", "x", block_rows=17).toPandas()
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    for i in (0, 7, 70, 118):
        exp = np.lexsort((np.arange(len(X)), D[i]))[:4]
        got = nn[nn.id == i].sort_values("rank")["rid"].tolist()
        assert got == exp.tolist()


def test_dbscan_blobs_and_noise(spark):
    df, X = _points(spark)
    lab = NB.dbscan(df, "id", "x", eps=0.8, min_samples=4, block_rows=25).toPandas().set_index("id")["cluster"].sort_index()
    assert set(lab.iloc[:60]) == {0} and set(lab.iloc[60:115]) == {1}
    assert (lab.iloc[115:] == -1).all()


def test_range_counts(spark):
    df, X = _points(spark, n=40)
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    got = NB.range_counts(df, 1.0, "id", "x", block_rows=9).toPandas().set_index("id")["n_neighbors"]
    assert all(got[i] == int((D[i] <= 1.0).sum()) for i in range(len(X)))


def test_knn_classify_votes(spark):
    df, _ = _points(spark)
    test = df.where(F.col("id").isin(3, 80))
    train = df.where(~F.col("id").isin(3, 80))
    pred = {r["id"]: r["prediction"] for r in NB.knn_classify(train, test, 5, "id", "x", "lab").collect()}
    assert pred == {3: 0, 80: 1}


def test_versions_and_retention(spark):
    rows = [("m1", v, v != 5) for v in range(1, 6)] + [("m2", 1, True)]
    runs = spark.createDataFrame(rows, "model_id string, version int, has_model boolean")
    s = {r["model_id"]: (r["latest_version"], r["latest_with_model"], r["next_version"])
         for r in RU.version_summary(runs).collect()}
    assert s == {"m1": (5, 4, 6), "m2": (1, 1, 2)}
    kept = sorted(r["version"] for r in RU.retained_versions(runs, 5).where("model_id = 'm1'").collect())
    assert kept == [2, 3, 4, 5]


def test_runs_table_retention(spark, tmp_path):
    path = str(tmp_path / "runs")
    for i in range(7):
        RU.append_run(spark, path, "m1", "regression", "ridge", {"r2": 0.1 * i}, has_model=(i != 6))
    RU.append_run(spark, path, "m2", "classification", "lr", {"accuracy": 0.5})
    runs = spark.read.parquet(path)
    v1 = sorted(r["version"] for r in runs.where("model_id = 'm1'").collect())
    assert v1 == [3, 4, 5, 6, 7]            # newest 4 kept before each new run, then the new one
    assert RU.latest_model_version(spark, path, "m1") == 6
    assert [r["version"] for r in runs.where("model_id = 'm2'").collect()] == [1]
