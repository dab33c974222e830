"""Model menu (M1-M21) mapped onto Spark ML, plus closed-form models kept as aggregates.

Regularised linear models translate the reference's penalty parameters into Spark's
(``regParam``, ``elasticNetParam``) so that the same objective is minimised:

* ridge (alpha):      regParam = alpha * sd_pop(y) / n, elasticNetParam = 0
* lasso (alpha):      regParam = alpha, elasticNetParam = 1
* elastic net (a, r): l1 = a r, l2 = a (1 - r) sd_pop(y); regParam = l1 + l2,
                      elasticNetParam = l1 / regParam
* logistic (C):       regParam = 1 / (C n), elasticNetParam = 0

all with ``standardization=False`` (features are scaled by the preparation step). The linear
family uses the ``normal`` solver: one distributed pass builds the Gram matrix (a
treeAggregate of d x d partial sums), the small system is solved on the driver. With the
population std of the label this reproduces the closed-form ridge and coordinate-descent
elastic-net solutions to ~1e-9. Plain least squares is the ridge limit with a vanishing
penalty (1e-10), i.e. the minimum-norm solution when features are collinear.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


# Default model parameters of the reference configuration.
REGRESSION_DEFAULTS = {
    "ridge": {"alpha": 1.0},
    "lasso": {"alpha": 0.1},
    "elastic_net": {"alpha": 0.1, "l1_ratio": 0.5},
    "decision_tree": {"max_depth": 10},
    "random_forest": {"n_estimators": 100, "max_depth": None},
    "gradient_boosting": {"n_estimators": 100, "learning_rate": 0.1},
}
REGRESSION_MODELS = ("linear_regression", "ridge", "lasso", "elastic_net", "decision_tree", "random_forest",
                     "gradient_boosting")
CLASSIFICATION_MODELS = ("logistic_regression", "decision_tree", "random_forest", "gradient_boosting", "knn",
                         "naive_bayes", "svm", "mlp")
SPARK_MAX_DEPTH = 30            # Spark trees reject deeper limits; "unlimited" maps here


# ---------------------------------------------------------------- closed forms

def linear_1d(df: DataFrame, x: str, y: str) -> DataFrame:
    """Ordinary least squares with one feature (M1 parity check): slope, intercept, r2, n."""
    return df.agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"),
                  F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
                  F.regr_r2(F.col(y), F.col(x)).alias("r2"), F.regr_count(F.col(y), F.col(x)).alias("n"))


class GaussianNBModel:
    """Per-class priors, means and variances; prediction = argmax of the joint log-likelihood
    (ties -> smallest class). Transform is one projection with k literal terms."""

    def __init__(self, features, label, stats, eps):
        self.features, self.label, self.stats, self.eps = list(features), label, stats, eps

    def log_likelihood(self):
        out = []
        total = sum(s["n"] for s in self.stats)
        for s in self.stats:
            term = F.lit(math.log(s["n"] / total))
            for i, c in enumerate(self.features):
                m, v = s["m"][i], s["v"][i] + self.eps
                term = term - F.lit(0.5 * math.log(2 * math.pi * v)) - (F.col(c) - F.lit(m)) ** 2 / F.lit(2 * v)
            out.append((s["cls"], term))
        return out

    def transform(self, df: DataFrame, out_col: str = "prediction") -> DataFrame:
        terms = self.log_likelihood()
        # classes in ascending order; of equal terms the greatest struct is that of the smallest class
        best = F.array_max(F.array(*[F.struct(t.alias("s"), F.lit(-i).alias("i")) for i, (_, t) in enumerate(terms)]))
        return df.withColumn(out_col, F.get(F.array(*[F.lit(cls) for cls, _ in terms]), -best["i"]))


class GaussianNB:
    """Gaussian naive Bayes (M13) fitted with one grouped aggregate; variance smoothing is
    1e-9 x the largest feature variance (population variances, like the reference)."""

    def __init__(self, features: Sequence[str], label: str, var_smoothing: float = 1e-9):
        self.features, self.label, self.var_smoothing = list(features), label, var_smoothing

    def fit(self, df: DataFrame) -> GaussianNBModel:
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(self.features):
            aggs += [F.avg(F.col(c)).alias(f"m{i}"), F.var_pop(F.col(c)).alias(f"v{i}")]
        rows = df.where(F.col(self.label).isNotNull()).groupBy(F.col(self.label).alias("cls")).agg(*aggs).collect()
        allv = df.agg(*[F.var_pop(F.col(c)).alias(f"v{i}") for i, c in enumerate(self.features)]).first()
        eps = self.var_smoothing * max(allv[f"v{i}"] or 0.0 for i in range(len(self.features)))
        stats = sorted(({"cls": r["cls"], "n": r["n"], "m": [r[f"m{i}"] for i in range(len(self.features))],
                         "v": [r[f"v{i}"] for i in range(len(self.features))]} for r in rows), key=lambda s: s["cls"])
        return GaussianNBModel(self.features, self.label, stats, eps)


# ---------------------------------------------------------------- Spark ML menus

def regression_estimator(name: str, params: dict | None, y_sd: float, n: int, features_col: str = "features",
                         label_col: str = "label", weight_col: str | None = None, seed: int = 42,
                         n_features: int | None = None):
    """``y_sd`` is the population standard deviation of the training label. The normal
    equations are used up to 4096 features (Spark's limit), L-BFGS beyond."""
    from pyspark.ml import regression as R
    solver = "normal" if (n_features or 0) <= 4096 else "l-bfgs"
    p = {**REGRESSION_DEFAULTS.get(name, {}), **(params or {})}
    common = {"featuresCol": features_col, "labelCol": label_col}
    if name == "linear_regression":
        return R.LinearRegression(regParam=1e-10 * y_sd, elasticNetParam=0.0, solver=solver,
                                  standardization=False, **common)
    if name == "ridge":
        return R.LinearRegression(regParam=p["alpha"] * y_sd / n, elasticNetParam=0.0, solver=solver,
                                  standardization=False, **common)
    if name == "lasso":
        return R.LinearRegression(regParam=p["alpha"], elasticNetParam=1.0, solver=solver, standardization=False,
                                  maxIter=200, tol=1e-8, **common)
    if name == "elastic_net":
        l1 = p["alpha"] * p["l1_ratio"]
        l2 = p["alpha"] * (1 - p["l1_ratio"]) * y_sd
        reg = l1 + l2
        return R.LinearRegression(regParam=reg, elasticNetParam=(l1 / reg if reg else 0.0), solver=solver,
                                  standardization=False, maxIter=200, tol=1e-8, **common)
    if name == "decision_tree":
        return R.DecisionTreeRegressor(maxDepth=min(p.get("max_depth") or SPARK_MAX_DEPTH, SPARK_MAX_DEPTH),
                                       seed=seed, **common)
    if name == "random_forest":
        depth = p.get("max_depth") or 12
        return R.RandomForestRegressor(numTrees=p["n_estimators"], maxDepth=min(depth, SPARK_MAX_DEPTH),
                                       maxMemoryInMB=1024, cacheNodeIds=True, seed=seed, **common)
    if name == "gradient_boosting":
        return R.GBTRegressor(maxIter=p["n_estimators"], stepSize=p["learning_rate"], maxDepth=3, seed=seed, **common)
    raise ValueError(f"unknown regression model {name!r}")


def classification_estimator(name: str, params: dict | None, n: int, n_classes: int, n_features: int,
                             features_col: str = "features", label_col: str = "label",
                             weight_col: str | None = None, seed: int = 42, id_cols: Sequence[str] | None = None):
    from pyspark.ml import classification as C
    p = dict(params or {})
    common = {"featuresCol": features_col, "labelCol": label_col}
    wc = {"weightCol": weight_col} if weight_col else {}
    if name == "logistic_regression":
        c = p.get("C", 1.0)
        return C.LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False,
                                    maxIter=p.get("max_iter", 1000), family="auto", **common, **wc)
    if name == "decision_tree":
        return C.DecisionTreeClassifier(maxDepth=min(p.get("max_depth") or SPARK_MAX_DEPTH, SPARK_MAX_DEPTH),
                                        seed=seed, **common, **wc)
    if name == "random_forest":
        return C.RandomForestClassifier(numTrees=p.get("n_estimators", 100),
                                        maxDepth=min(p.get("max_depth") or 12, SPARK_MAX_DEPTH), seed=seed,
                                        maxMemoryInMB=1024, cacheNodeIds=True, **common, **wc)
    if name == "gradient_boosting":
        gbt = C.GBTClassifier(maxIter=p.get("n_estimators", 100), stepSize=p.get("learning_rate", 0.1), maxDepth=3,
                              seed=seed, **common, **wc)
        return gbt if n_classes <= 2 else C.OneVsRest(classifier=gbt, **common, **wc)
    if name == "naive_bayes":
        return C.NaiveBayes(modelType="gaussian", **common, **wc)
    if name == "svm":
        svc = C.LinearSVC(maxIter=p.get("max_iter", 100), regParam=p.get("reg", 0.0), **common, **wc)
        return svc if n_classes <= 2 else C.OneVsRest(classifier=svc, **common, **wc)
    if name == "mlp":
        return C.MultilayerPerceptronClassifier(layers=[n_features, 100, 50, max(n_classes, 2)],
                                                maxIter=p.get("max_iter", 500), seed=seed, **common)
    if name == "knn":
        from tabforge.operators.knn import KNNClassifier
        if not id_cols:
            raise ValueError("knn needs the columns that name a row")
        return KNNClassifier(id_cols, n_classes, p.get("n_neighbors", 5), p.get("weights", "uniform"), p.get("p", 2), features_col, label_col)
    raise ValueError(f"unknown classification model {name!r}")


#: Cells (rows by features) up to which a forest is Spark ML's own.
FEW_CELLS = 1 << 21


def fit(est, df: DataFrame, n: int, n_features: int):
    """``est`` fitted on the ``n`` rows of ``df``; random forests of many cells by ``operators/forest.py``."""
    from tabforge.operators import forest
    if n * n_features > FEW_CELLS and forest.fits(est):
        return forest.fit_forest(est, df, n)
    return est.fit(df)


def _importance_values(model) -> list[float] | None:
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray().tolist()
    if hasattr(model, "coefficientMatrix") and getattr(model, "numClasses", 2) > 2:
        m = model.coefficientMatrix.toArray()
        return [float(abs(m[:, j]).mean()) for j in range(m.shape[1])]
    if hasattr(model, "coefficients"):
        return [abs(v) for v in model.coefficients.toArray().tolist()]
    if hasattr(model, "models"):                     # one-vs-rest: the mean over its classes
        each = [_importance_values(m) for m in model.models]
        return None if any(v is None for v in each) else [sum(v) / len(each) for v in zip(*each)]
    return None


def feature_importances(model, slot_names: Sequence[str], top: int = 10) -> list[tuple[str, float]]:
    """Tree importances, or |coefficients| for linear models, sorted, top ``top``."""
    vals = _importance_values(model)
    if vals is None:
        return []
    names = list(slot_names) + [f"f{i}" for i in range(len(slot_names), len(vals))]
    return sorted(zip(names, vals), key=lambda kv: (-kv[1], kv[0]))[:top]


def complexity(model) -> dict[str, int]:
    """Nodes / depth / trees / coefficients of a fitted model (H11); of one-vs-rest the sums over its classes."""
    if hasattr(model, "models"):
        out: dict[str, int] = {"n_classifiers": len(model.models)}
        for m in model.models:
            for key, v in complexity(m).items():
                out[key] = out.get(key, 0) + v
        return out
    out = {}
    for attr, key in (("numNodes", "n_nodes"), ("depth", "depth"), ("getNumTrees", "n_estimators"),
                      ("totalNumNodes", "total_nodes")):
        if hasattr(model, attr):
            v = getattr(model, attr)
            out[key] = int(v() if callable(v) else v)
    if hasattr(model, "coefficientMatrix"):
        m = model.coefficientMatrix.toArray()
        out["n_coef"], out["n_nonzero"] = int(m.size), int((m != 0).sum())
    elif hasattr(model, "coefficients"):
        c = model.coefficients
        out["n_coef"], out["n_nonzero"] = int(c.size), int(c.numNonzeros())
    return out
