"""Random forests over binned blocks: against brute force on the same bags, grown by passes and by subtrees, as Spark's models."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import functions as F

from tabforge.operators import forest as FO
from tabforge.operators import models as MD


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(3000, 4)), 1)
    y = 1e6 + 5 * (x[:, 0] > 0.3) + x[:, 1] * x[:, 2] + rng.normal(size=3000) / 10
    rows = [(i, [float(v) for v in r], float(t), float(r[0] > 0) + float(r[1] > 0.5), 1.0 + i % 3) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double, cls double, weight double")
    return df.select("*", array_to_vector("x").alias("features"), array_to_vector(F.slice("x", 1, 1)).alias("one")).repartition(4, "id").persist()


def nodes(spark, model, tmp_path, name):
    """The stored nodes of a model by tree and place."""
    model.save(str(tmp_path / name))
    n = spark.read.parquet(str(tmp_path / name / "data")).select("treeID", "nodeData.*").toPandas()
    return {(r.treeID, r.id): r for r in n.itertuples()}


def test_trees_by_passes_and_by_subtrees_are_the_same(spark, table, tmp_path, monkeypatch):
    """With one feature nothing but the bags is drawn, so both ways grow the same trees."""
    got = []
    for rows in (0, 700, 1 << 16):
        monkeypatch.setattr(FO, "SUBTREE_ROWS", rows)
        monkeypatch.setattr(FO, "SUM_CELLS", 100)
        monkeypatch.setattr(FO, "CHUNK_ROWS", 200)
        monkeypatch.setattr(FO, "BLOCK_ROWS", 250)
        est = RandomForestRegressor(numTrees=3, maxDepth=4, featuresCol="one", seed=7)
        got.append(FO.fit_forest(est, table, 3000).transform(table).select("id", "prediction").orderBy("id").toPandas()["prediction"].to_numpy())
    assert np.allclose(got[0], got[1], rtol=0, atol=1e-6) and np.allclose(got[0], got[2], rtol=0, atol=1e-6)
    assert len(np.unique(got[0])) > 8


def test_a_tree_against_brute_force(spark, table, tmp_path):
    """The best threshold of every node over the bagged rows, tried one by one."""
    rows = table.select("id", F.get("x", 0).alias("x"), "label").toPandas()
    x, y = rows["x"].to_numpy(), rows["label"].to_numpy()
    thresholds = FO.split_points(x, 31)
    codes = np.searchsorted(thresholds, x).astype(np.uint8)
    bag = FO._bag(7, 0, 0, len(x))
    keep = bag > 0
    codes, v, w = codes[keep], y[keep] - y.mean(), bag[keep].astype(float)
    s = {"width": 1, "k": 1, "bins": 32, "classes": 0, "depth": 3, "least": 1e-12}
    got = FO.grow(codes, v, w, bag[keep], 0, (7, 0, 0), s)

    def expected(rows, level):
        mean = np.average(v[rows], weights=w[rows])
        best = (1e-12, None)
        for b in range(31):
            a = codes[rows] <= b
            if 0 < a.sum() < len(a):
                parts = [rows[a], rows[~a]]
                after = sum(w[p] @ (v[p] - np.average(v[p], weights=w[p])) ** 2 for p in parts)
                gain = (w[rows] @ (v[rows] - mean) ** 2 - after) / w[rows].sum()
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, b)
        node = (mean, None if level == 3 else best[1])
        if node[1] is None:
            return [node]
        a = codes[rows] <= best[1]
        return [node, *expected(rows[a], level + 1), *expected(rows[~a], level + 1)]

    def grown(i):
        mean = got["totals"][i, 1] / got["totals"][i, 0]
        if got["left"][i] < 0:
            return [(mean, None)]
        a = got["left"][i]
        return [(mean, got["code"][i]), *grown(a), *grown(a + 1)]
    want, have = expected(np.arange(len(v)), 0), grown(0)
    assert [b for _, b in want] == [b for _, b in have] and np.allclose([m for m, _ in want], [m for m, _ in have])


def test_it_is_sparks_model_and_as_good(spark, table, tmp_path):
    test, train = table.where("id % 5 = 0"), table.where("id % 5 > 0").persist()
    est = RandomForestRegressor(numTrees=20, maxDepth=8, seed=42)
    ours, sparks = FO.fit_forest(est, train, train.count()), est.fit(train)
    assert isinstance(ours, RandomForestRegressionModel) and ours.getNumTrees == 20 and ours.numFeatures == 4
    error = [m.transform(test).select(F.avg((F.col("label") - F.col("prediction")) ** 2)).first()[0] for m in (ours, sparks)]
    assert error[0] < 1.15 * error[1]
    assert np.allclose(ours.featureImportances.toArray(), sparks.featureImportances.toArray(), atol=0.08)
    assert 0.8 < ours.totalNumNodes / sparks.totalNumNodes < 1.25
    every = nodes(spark, ours, tmp_path, "regression")
    assert len(every) == ours.totalNumNodes
    for (t, i), r in every.items():
        n, total, square = r.impurityStats
        assert r.prediction == pytest.approx(total / n) and r.rawCount == n
        assert r.impurity == pytest.approx(square / n - (total / n) ** 2, abs=1e-2)
        if r.leftChild >= 0:
            a, b = every[t, r.leftChild], every[t, r.rightChild]
            assert n == a.impurityStats[0] + b.impurityStats[0]
            assert r.gain == pytest.approx(r.impurity - (a.rawCount * a.impurity + b.rawCount * b.impurity) / n, abs=1e-6)


@pytest.mark.parametrize("rows", [0, 1 << 16])
def test_classes_with_weights(spark, table, monkeypatch, rows):
    monkeypatch.setattr(FO, "SUBTREE_ROWS", rows)
    est = RandomForestClassifier(numTrees=10, maxDepth=6, labelCol="cls", weightCol="weight", seed=42)
    model = FO.fit_forest(est, table, 3000)
    assert isinstance(model, RandomForestClassificationModel) and model.numClasses == 3
    got = model.transform(table).select("cls", "prediction", vector_to_array("probability").alias("p")).toPandas()
    assert (got["cls"] == got["prediction"]).mean() > 0.97
    assert np.allclose(got["p"].map(sum), 1)


def test_forests_of_many_cells_only(spark, table, monkeypatch):
    est = RandomForestRegressor(numTrees=2, maxDepth=2, seed=1)
    called = []
    monkeypatch.setattr(FO, "fit_forest", lambda *a: called.append(a))
    assert MD.fit(est, table, 3000, 4) is not None and not called
    assert MD.fit(est, table, MD.FEW_CELLS, 4) is None and len(called) == 1
    assert not FO.fits(RandomForestRegressor(subsamplingRate=0.5)) and not FO.fits(RandomForestRegressor(numTrees=1))


def test_split_points():
    assert FO.split_points(np.array([3.0, 1.0, 1.0, np.nan]), 31).tolist() == [2.0]
    assert FO.split_points(np.ones(5), 31).tolist() == []
    assert FO.split_points(np.arange(64.0), 3).tolist() == [15.5, 31.5, 47.5]
