"""Random search with k-fold cross validation (H1, H2) on Spark ML's CrossValidator.

The parameter grid is enumerated and, when larger than ``n_iter``, sampled with a seeded
RNG (a grid smaller than ``n_iter`` is tried whole). Folds come from a hash of the row key
(``foldCol``), of classification within each class, so they are the same on every run and every partitioning. Candidates are
fitted in parallel (``parallelism``); the best candidate is refit on all training rows as
``{name}_optimized``.
"""

from __future__ import annotations

import itertools
import random
import statistics

from pyspark import StorageLevel
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, Window, functions as F

from tabforge.session import spread
from tabforge.functions.hashing import hash_fold
from tabforge.operators import models as MD
from tabforge.operators.knn import KNNClassifier, knn, row_key
from tabforge.operators.prepare import stratified_folds

# Search spaces of the reference configuration (sklearn names).
REGRESSION_GRIDS = {
    "random_forest": {"n_estimators": [50, 100, 150, 200], "max_depth": [5, 10, 15, 20, 25, 30, None],
                      "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4],
                      "max_features": ["sqrt", "log2", None]},
    "gradient_boosting": {"n_estimators": [50, 100, 150, 200], "learning_rate": [0.01, 0.05, 0.1, 0.15, 0.2],
                          "max_depth": [2, 3, 4, 5, 6], "min_samples_split": [2, 5, 10],
                          "subsample": [0.7, 0.8, 0.9, 1.0]},
    "elastic_net": {"alpha": [0.0001, 0.001, 0.01, 0.1, 0.5, 1.0, 10.0], "l1_ratio": [0.1, 0.3, 0.5, 0.7, 0.9]},
    "ridge": {"alpha": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]},
}
CLASSIFICATION_GRIDS = {
    "random_forest": {"n_estimators": [50, 100, 150, 200], "max_depth": [5, 10, 15, 20, 25, None],
                      "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4],
                      "max_features": ["sqrt", "log2", None]},
    "gradient_boosting": {"n_estimators": [50, 100, 150, 200], "learning_rate": [0.01, 0.05, 0.1, 0.2],
                          "max_depth": [2, 3, 4, 5], "min_samples_split": [2, 5, 10],
                          "subsample": [0.7, 0.8, 0.9, 1.0]},
    "logistic_regression": {"C": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0], "penalty": ["l1", "l2", "elasticnet"],
                            "max_iter": [1000]},
    "knn": {"n_neighbors": [3, 5, 7, 9, 11, 13], "weights": ["uniform", "distance"], "p": [1, 2]},
}
# sklearn-only knobs with no Spark counterpart are dropped from the sampled points
UNMAPPED = {"min_samples_split", "solver"}


class BalancedAccuracy(Evaluator):
    """Mean recall over the classes present in the label column (an aggregate query)."""

    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self.labelCol, self.predictionCol = labelCol, predictionCol

    def _evaluate(self, dataset: DataFrame) -> float:
        r = dataset.groupBy(self.labelCol).agg(
            F.avg(F.when(F.col(self.labelCol) == F.col(self.predictionCol), 1.0).otherwise(0.0)).alias("recall"))
        return float(r.agg(F.avg("recall")).first()[0])

    def isLargerBetter(self) -> bool:
        return True


def sample_grid(grid: dict, n_iter: int, seed: int = 42) -> list[dict]:
    keys = sorted(grid)
    points = [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]
    if len(points) <= n_iter:
        return points
    return random.Random(seed).sample(points, n_iter)


def _spark_params(est, name: str, point: dict, y_sd: float, n: int) -> dict:
    """Map one sklearn-style point onto the estimator's Spark params."""
    m = {}
    p = {k: v for k, v in point.items() if k not in UNMAPPED}
    if name == "random_forest":
        m[est.numTrees] = p["n_estimators"]
        m[est.maxDepth] = min(p["max_depth"] or MD.SPARK_MAX_DEPTH, MD.SPARK_MAX_DEPTH)
        m[est.minInstancesPerNode] = p["min_samples_leaf"]
        m[est.featureSubsetStrategy] = p["max_features"] or "all"
    elif name == "gradient_boosting":
        m[est.maxIter] = p["n_estimators"]
        m[est.stepSize] = p["learning_rate"]
        m[est.maxDepth] = p["max_depth"]
        m[est.subsamplingRate] = p["subsample"]
    elif name == "ridge":
        m[est.regParam] = p["alpha"] * y_sd / n
        m[est.elasticNetParam] = 0.0
    elif name == "elastic_net":
        l1 = p["alpha"] * p["l1_ratio"]
        l2 = p["alpha"] * (1 - p["l1_ratio"]) * y_sd
        m[est.regParam] = l1 + l2
        m[est.elasticNetParam] = l1 / (l1 + l2) if l1 + l2 else 0.0
    elif name == "logistic_regression":
        m[est.regParam] = 1.0 / (p["C"] * n)
        m[est.elasticNetParam] = {"l1": 1.0, "l2": 0.0, "elasticnet": 0.5}[p["penalty"]]
        m[est.maxIter] = p["max_iter"]
    return m


def _row(name: str, points: list[dict], scores: list[float], best_i: int, stds: list[float], problem: str) -> tuple:
    best = scores[best_i]
    display = best ** 0.5 if problem == "regression" else best   # RMSE for regression
    return (f"{name}_optimized", len(points), str(points[best_i]), float(statistics.mean(scores)), float(statistics.pstdev(scores)),
            float(min(scores)), float(max(scores)), float(best), float(display), float(stds[best_i]))


def search_knn(data: DataFrame, id_cols, points: list[dict], cv: int, balanced: bool) -> tuple[list[float], list[float]]:
    """(mean, deviation over folds) of each k-NN candidate: one neighbour join a fold and p with the largest k,
    from which all candidates vote together."""
    rows = data.select(row_key(id_cols).alias("__q"), "features", F.col("label").alias("__lab"), "fold")
    scores: dict[int, list[float]] = {i: [] for i in range(len(points))}
    for fold in range(cv):
        held, rest = rows.where(F.col("fold") == fold), rows.where(F.col("fold") != fold)
        for p in sorted({pt["p"] for pt in points}):
            mine = [(i, pt["n_neighbors"], pt["weights"]) for i, pt in enumerate(points) if pt["p"] == p]
            nn = knn(held, rest.withColumnRenamed("__q", "__rid"), max(k for _, k, _ in mine), "__q", "__rid", "features", p=p)
            named = nn.join(rest.select(F.col("__q").alias("__rid"), "__lab"), "__rid")
            each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.lit(w).alias("w")) for i, k, w in mine])
            cast = named.withColumn("c", F.explode(each)).where(F.col("rank") <= F.col("c.k"))
            zero = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy("__q", "c.i"))
            vote = F.when(F.col("c.w") == "uniform", F.lit(1.0)).when(F.col("zero") == 1, (F.col("dist") == 0).cast("double")) \
                .otherwise(1 / F.col("dist"))
            counted = cast.withColumn("zero", zero).groupBy("__q", F.col("c.i").alias("i"), "__lab").agg(F.sum(vote).alias("v"))
            best = counted.groupBy("__q", "i").agg(F.min(F.struct((-F.col("v")).alias("v"), "__lab")).alias("b"))
            right = best.join(held.select("__q", "__lab"), "__q").select("i", "__lab", (F.col("b.__lab") == F.col("__lab")).cast("double").alias("ok"))
            if balanced:
                right = right.groupBy("i", "__lab").agg(F.avg("ok").alias("ok"))
            for r in right.groupBy("i").agg(F.avg("ok").alias("s")).collect():
                scores[r["i"]].append(r["s"])
    return [statistics.mean(v) for v in scores.values()], [statistics.pstdev(v) for v in scores.values()]


def random_search(train_feats: DataFrame, problem: str, id_cols, models=None, n_iter: int = 20, cv: int = 5,
                  seed: int = 42, parallelism: int = 4, balanced: bool = False,
                  n_classes: int = 2) -> tuple[DataFrame, dict]:
    """Search every model with a grid; returns a table (model, n_candidates, best params,
    cv mean / std / min / max of the score, best score) and the refit models."""
    grids = REGRESSION_GRIDS if problem == "regression" else CLASSIFICATION_GRIDS
    models = [m for m in (models or grids) if m in grids]
    if problem == "regression":
        data = train_feats.withColumn("fold", hash_fold(id_cols, cv, seed))
    else:
        data = stratified_folds(train_feats, "label", id_cols, cv, seed)
    data = spread(data).persist(StorageLevel.MEMORY_AND_DISK)
    st = data.agg(F.stddev_pop("label").alias("sd"), F.count(F.lit(1)).alias("n")).first()
    nfeat = len(data.select("features").first()["features"])
    if problem == "regression":
        evaluator = RegressionEvaluator(metricName="mse")
    elif balanced:
        evaluator = BalancedAccuracy()
    else:
        evaluator = MulticlassClassificationEvaluator(metricName="accuracy")
    rows, refit = [], {}
    for name in models:
        if problem == "regression":
            est = MD.regression_estimator(name, None, st["sd"] or 1.0, st["n"], n_features=nfeat)
        else:
            est = MD.classification_estimator(name, None, st["n"], n_classes, nfeat, id_cols=id_cols)
        points = sample_grid(grids[name], n_iter, seed)
        if name == "knn":
            scores, stds = search_knn(data, id_cols, points, cv, balanced)
            best_i = max(range(len(points)), key=lambda i: scores[i])
            rows.append(_row(name, points, scores, best_i, stds, problem))
            refit[f"{name}_optimized"] = KNNClassifier(id_cols, n_classes, **points[best_i]).fit(data)
            continue
        # of one-vs-rest, the parameters are those of the model it repeats
        inner = est.getClassifier() if hasattr(est, "getClassifier") else est
        # a fold trains on (cv - 1) / cv of the rows, and penalties that are sums over rows go by those
        maps = [_spark_params(inner, name, pt, st["sd"] or 1.0, st["n"] * (cv - 1) / cv) for pt in points]
        cvm = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=evaluator, foldCol="fold", numFolds=cv,
                             parallelism=parallelism, seed=seed).fit(data)
        scores = list(cvm.avgMetrics)
        stds = list(getattr(cvm, "stdMetrics", []) or [0.0] * len(scores))
        best_i = (min if not evaluator.isLargerBetter() else max)(range(len(scores)), key=lambda i: scores[i])
        rows.append(_row(name, points, scores, best_i, stds, problem))
        full = _spark_params(inner, name, points[best_i], st["sd"] or 1.0, st["n"])
        refit[f"{name}_optimized"] = cvm.bestModel if full == maps[best_i] else est.fit(data, full)
    data.unpersist()
    table = train_feats.sparkSession.createDataFrame(
        rows, "model string, n_candidates int, best_params string, cv_mean double, cv_std double, cv_min double, "
              "cv_max double, best_cv_score double, best_score double, best_fold_std double")
    return table, refit
