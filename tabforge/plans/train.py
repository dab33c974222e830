"""Training plans for regression and classification.

Flow: checks -> split (hash, deterministic) -> preparation fitted on train ->
features persisted once -> every model fitted (driver thread pool, each fit a set of
distributed Spark ML jobs) -> test predictions -> metrics as aggregates ->
leaderboard DataFrame -> best model by rank-1 selection.
"""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from tabforge.operators import metrics as M
from tabforge.operators import models as MD
from tabforge.operators import prepare as R
from tabforge.operators.checks import validation_checks
from tabforge.plans.prepare import Prepared, fit_preparation, merged_config, training_rows
from tabforge.functions.scalars import attach
from tabforge.session import Written, spread

REG_METRICS = ("r2", "rmse", "mae", "mape")
HIGHER_IS_BETTER = {"r2": True, "rmse": False, "mae": False, "mape": False, "accuracy": True,
                    "balanced_accuracy": True, "f1_macro": True, "f1_binary": True, "precision_macro": True,
                    "recall_macro": True, "roc_auc": True, "silhouette": True, "mcc": True, "average_precision": True,
                    "log_loss": False}
CLS_METRICS = ("accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_weighted",
               "recall_weighted", "f1_weighted", "precision_binary", "recall_binary", "f1_binary", "mcc", "log_loss")


def resolve_metric(name: str, n_classes: int) -> str:
    """Leaderboard column of a metric name of classification: 'precision', 'recall' and 'f1' are those of the
    positive class with two classes and macro averages beyond; 'auc' needs two classes, else accuracy is used."""
    if name in ("precision", "recall", "f1"):
        return f"{name}_{'binary' if n_classes == 2 else 'macro'}"
    if name in ("auc", "roc_auc"):
        return "roc_auc" if n_classes == 2 else "accuracy"
    if name not in (*CLS_METRICS, "average_precision"):
        raise ValueError(f"unknown classification metric {name!r}")
    return name


def _complexity(model) -> str:
    """The counts of a fitted model as JSON, in the order of their names."""
    return json.dumps(MD.complexity(model), sort_keys=True)


def model_details(models: dict, slot_names, spark) -> DataFrame:
    """(model, feature, importance) of every model that has importances."""
    rows = [(name, f, v) for name, m in models.items() for f, v in MD.feature_importances(m, slot_names)]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def searched(tr: DataFrame, problem: str, id_cols, search: dict | None, **kw) -> tuple[dict, DataFrame | None]:
    """Random search beside the plain models (H1): fitted ``*_optimized`` models and the table of the search."""
    if not search:
        return {}, None
    from tabforge.plans.search import random_search
    t0 = time.time()
    table, refit = random_search(tr, problem, id_cols, **{**kw, **search})
    share = (time.time() - t0) / max(len(refit), 1)
    return {name: (m, share, None) for name, m in refit.items()}, table


@dataclass
class TrainResult:
    problem: str
    prep: Prepared
    models: dict
    leaderboard: DataFrame
    best_model: str | None
    predictions: DataFrame | None
    checks: DataFrame
    importances: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    def release(self) -> None:
        """Drop the persisted tables (predictions recompute deterministically if used later)."""
        for f in (self.extra.get("features"), self.extra.get("rows")):
            if f is not None:
                f.unpersist()

    def pipeline(self, name: str | None = None) -> PipelineModel:
        """Preparation + chosen model as one persistable PipelineModel."""
        m = self.models[name or self.best_model]
        return PipelineModel(self.prep.model.stages + [m])


def split_table(df: DataFrame, target: str, id_cols, problem: str, cfg: dict) -> DataFrame:
    sp = cfg["train_test_split"]
    if problem == "classification" and sp.get("stratify", True):
        return R.split_stratified(df, target, id_cols, sp["test_size"], sp["random_state"])
    return R.split_random(df, id_cols, sp["test_size"], sp["random_state"])


def _fit_all(estimators: dict, train_feats: DataFrame, parallelism: int, n: int, n_features: int):
    out = {}

    def fit(item):
        name, est = item
        t0 = time.time()
        try:
            return name, MD.fit(est, train_feats, n, n_features), time.time() - t0, None
        except Exception as e:  # noqa: BLE001 - one failing candidate must not stop the run (H12)
            return name, None, time.time() - t0, f"{type(e).__name__}: {e}"

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        for name, model, secs, err in ex.map(fit, estimators.items()):
            out[name] = (model, secs, err)
    return out


def rank_best(board: DataFrame, metric: str, order_col: str = "model_order") -> DataFrame:
    """Rank-1 pick (W10): best ``metric`` first, the earlier model on ties; NULL metrics last."""
    m = F.col(metric)
    key = m.desc_nulls_last() if HIGHER_IS_BETTER.get(metric, True) else m.asc_nulls_last()
    # the leaderboard has one row per model: an un-partitioned window over it is tiny
    return board.withColumn("rank", F.row_number().over(Window.orderBy(key, F.col(order_col))))


def train_regression(df: DataFrame, target: str, id_cols, cfg: dict | None = None,
                     models=MD.REGRESSION_MODELS, params: dict | None = None, parallelism: int = 4,
                     primary_metric: str = "r2", search: dict | None = None) -> TrainResult:
    """``search`` (arguments of ``random_search``, such as ``{"models": ["ridge"], "n_iter": 20}``) adds the best
    candidates as ``*_optimized`` rows of the leaderboard."""
    cfg = merged_config(None, cfg)
    checks = validation_checks(df, target, "regression")
    if checks.where("status = 'error'").count():
        raise ValueError("regression checks failed: " + str(checks.where("status = 'error'").collect()))
    # the rows with their split are read again and again while the preparation is fitted
    data = spread(split_table(df.where(F.col(target).isNotNull()), target, id_cols, "regression", cfg)).persist(StorageLevel.MEMORY_AND_DISK)
    train = data.where("split = 'train'")
    prep = fit_preparation(train, target, cfg, exclude=[*id_cols, "split"], problem="regression")
    feats = prep.model.transform(data).select(*id_cols, "split", "label", "features")
    feats = feats.persist(StorageLevel.MEMORY_AND_DISK)
    tr = training_rows(prep, train).select(*id_cols).join(feats.where("split = 'train'"), list(id_cols)) \
        if prep.params["outliers"].get("strategy") == "remove" else feats.where("split = 'train'")
    st = tr.agg(F.stddev_pop("label").alias("sd"), F.count(F.lit(1)).alias("n")).first()
    if prep.params["outliers"].get("strategy") != "remove":
        data.unpersist()
    ests = {name: MD.regression_estimator(name, (params or {}).get(name), st["sd"] or 1.0, st["n"],
                                          n_features=len(prep.slot_names)) for name in models}
    fitted = _fit_all(ests, tr, parallelism, st["n"], len(prep.slot_names))
    found, search_table = searched(tr, "regression", id_cols, search, parallelism=parallelism)
    fitted |= found
    models = [*models, *found]
    preds = None
    for name in models:
        model = fitted[name][0]
        if model is not None:
            p = model.transform(feats).select(*id_cols, "split", "label", "prediction").withColumn("model", F.lit(name))
            preds = p if preds is None else preds.unionByName(p)
    # every model's train and test metrics in one aggregate over the stacked predictions
    mt = {}
    if preds is not None:
        e = F.col("label") - F.col("prediction")
        for r in preds.groupBy("model", "split").agg(
                F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.avg(F.abs(e)).alias("mae"),
                F.var_pop("label").alias("vy"),
                F.avg(F.abs(e) / F.greatest(F.abs("label"), F.lit(M.EPS))).alias("mape")).collect():
            mt[(r["model"], r["split"])] = r

    def r2(r):
        return None if r is None or not r["vy"] else 1 - r["sse"] / (r["vy"] * r["n"])

    rows = []
    for order, name in enumerate(models):
        model, secs, err = fitted[name]
        if model is None:
            rows.append((name, order, False, err, secs) + (None,) * 7)
            continue
        te, trm = mt.get((name, "test")), mt.get((name, "train"))
        rmse = (te["sse"] / te["n"]) ** 0.5 if te else None
        rows.append((name, order, True, None, secs, r2(trm), r2(te), rmse, te["mae"] if te else None,
                     te["mape"] if te else None, (trm["sse"] / trm["n"]) ** 0.5 if trm else None, _complexity(model)))
    spark = df.sparkSession
    board = spark.createDataFrame(rows, "model string, model_order int, trained_successfully boolean, error string, "
                                        "train_seconds double, train_r2 double, r2 double, rmse double, mae double, "
                                        "mape double, train_rmse double, complexity string")
    board = overfit_and_baseline(board, "regression", primary_metric)
    board = rank_best(board, primary_metric)
    best = board.where("rank = 1").select("model").first()
    best_name = best["model"] if best else None
    imp = None
    if best_name and fitted[best_name][0] is not None:
        imp = spark.createDataFrame(MD.feature_importances(fitted[best_name][0], prep.slot_names),
                                    "feature string, importance double")
    done = {k: v[0] for k, v in fitted.items() if v[0] is not None}
    return TrainResult("regression", prep, done, board, best_name, preds, checks, imp,
                       {"features": feats, "rows": data, "search": search_table, "importances": model_details(done, prep.slot_names, spark)})


def overfit_and_baseline(board: DataFrame, problem: str, metric: str | None = None) -> DataFrame:
    """Overfitting flags (H9) and % improvement over the linear / logistic baseline in the primary metric (H8),
    positive where the model is better."""
    if problem == "regression":
        baseline, metric = "linear_regression", metric or "r2"
        over = ((F.col("train_r2") - F.col("r2")) > 0.2) | (F.col("rmse") > F.col("train_rmse") * 1.3)
    else:
        baseline, metric = "logistic_regression", metric or "accuracy"
        over = (F.col("train_accuracy") - F.col("accuracy")) > 0.1
    better = 1.0 if HIGHER_IS_BETTER.get(metric, True) else -1.0
    # an aggregate without groups has its row also where the baseline is missing
    j = attach(board, board.agg(F.max(F.when(F.col("model") == baseline, F.col(metric))).alias("_b")))
    return j.withColumn("baseline_improvement_pct",
                        F.when(F.col("_b") != 0, better * (F.col(metric) - F.col("_b")) / F.abs(F.col("_b")) * 100)) \
            .withColumn("overfit", F.coalesce(over, F.lit(False))).drop("_b")


def train_classification(df: DataFrame, target: str, id_cols, cfg: dict | None = None,
                         models=("logistic_regression", "decision_tree", "random_forest", "naive_bayes"),
                         params: dict | None = None, parallelism: int = 4, balance: str | None = None,
                         primary_metric: str | None = None, search: dict | None = None) -> TrainResult:
    """Classification with label encoding, optional balanced weights (F16) or SMOTE.

    ``search`` adds ``*_optimized`` rows, as in regression; candidates are compared by balanced accuracy where the
    rarest class has less than a fifth of the rows."""
    cfg = merged_config(None, cfg)
    checks = validation_checks(df, target, "classification")
    if checks.where("status = 'error'").count():
        raise ValueError("classification checks failed")
    data = spread(split_table(df.where(F.col(target).isNotNull()), target, id_cols, "classification", cfg)).persist(StorageLevel.MEMORY_AND_DISK)
    train = data.where("split = 'train'")
    prep = fit_preparation(train, target, cfg, exclude=[*id_cols, "split"], problem="classification")
    feats = prep.model.transform(data).select(*id_cols, "split", "label", "features")
    k = len(prep.label_classes)
    weight_col = None
    if balance == "weights":
        feats = R.with_class_weights(feats, "label", "weight", fit=feats.where("split = 'train'"))
        weight_col = "weight"
        feats = spread(feats)
    feats = feats.persist(StorageLevel.MEMORY_AND_DISK)
    tr = feats.where("split = 'train'")
    if prep.params["outliers"].get("strategy") == "remove":
        tr = training_rows(prep, train).select(*id_cols).join(tr, list(id_cols))
    if balance == "smote":
        from tabforge.operators.balance import smote
        tr = smote(tr, "label", "features", id_cols)
    n = tr.count()
    if prep.params["outliers"].get("strategy") != "remove":
        data.unpersist()
    nfeat = len(tr.select("features").first()["features"])
    ests = {m: MD.classification_estimator(m, (params or {}).get(m), n, k, nfeat, weight_col=weight_col, id_cols=id_cols)
            for m in models}
    fitted = _fit_all(ests, tr, parallelism, n, nfeat)
    shares = feats.where("split = 'train'").groupBy("label").count().agg(
        (F.min("count") / F.sum("count")).alias("s")).first()["s"]
    primary = resolve_metric(primary_metric or ("balanced_accuracy" if shares < 0.2 else "accuracy"), k)
    found, search_table = searched(tr, "classification", id_cols, search, parallelism=parallelism, balanced=shares < 0.2,
                                   n_classes=k)
    fitted |= found
    models = [*models, *found]
    preds = None
    classes = [str(c) for c in prep.label_classes]
    decode = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(float(i)), F.lit(c))])
    scored = set()
    for name in models:
        model = fitted[name][0]
        if model is None:
            continue
        p = model.transform(feats)
        none = F.lit(None).cast("double")
        probs = vector_to_array("probability") if "probability" in p.columns else None
        if probs is not None:
            scored.add(name)
        p = p.select(*id_cols, "split", decode[F.col("label")].alias("actual"), decode[F.col("prediction")].alias("predicted"),
                     (none if probs is None else F.array_max(probs)).alias("prediction_probability"),
                     (none if probs is None or k != 2 else probs[1]).alias("positive_score"),
                     (none if probs is None else F.get(probs, F.col("label").cast("int"))).alias("true_probability"),
                     F.lit(name).alias("model"))
        preds = p if preds is None else preds.unionByName(p)
    # every model's train and test metrics in one pass over the stacked predictions, which are written: the ranking metrics
    # read them some more times
    mt = {}
    if preds is not None:
        preds = Written(preds).df
        mt = {(r["model"], r["split"]): r for r in M.model_metrics(
            preds, ["model", "split"], "actual", "predicted", "true_probability", classes[-1] if k == 2 else None).collect()}
    rows = []
    for order, name in enumerate(models):
        model, secs, err = fitted[name]
        te, trm = mt.get((name, "test")), mt.get((name, "train"))
        auc = ap = None
        if model is not None and k == 2 and name in scored:
            rk = M.ranking_metrics(preds.where((F.col("model") == name) & (F.col("split") == "test")), "actual",
                                   "positive_score", positive=classes[-1]).first()
            auc, ap = rk["roc_auc"], rk["average_precision"]
        rows.append((name, order, model is not None, err, secs, trm["accuracy"] if trm else None,
                     *[te[c] if te else None for c in CLS_METRICS], auc, ap, None if model is None else _complexity(model)))
    spark = df.sparkSession
    board = spark.createDataFrame(rows, "model string, model_order int, trained_successfully boolean, error string, "
                                        "train_seconds double, train_accuracy double, "
                                        + ", ".join(f"{c} double" for c in CLS_METRICS)
                                        + ", roc_auc double, average_precision double, complexity string")
    board = overfit_and_baseline(board, "classification", primary)
    board = rank_best(board, primary)
    best = board.where("rank = 1").select("model").first()
    best_name = best["model"] if best else None
    imp = None
    if best_name and fitted[best_name][0] is not None:
        imp = spark.createDataFrame(MD.feature_importances(fitted[best_name][0], prep.slot_names),
                                    "feature string, importance double")
    done = {name: v[0] for name, v in fitted.items() if v[0] is not None}
    return TrainResult("classification", prep, done, board, best_name, preds, checks, imp,
                       {"features": feats, "rows": data, "primary_metric": primary, "search": search_table,
                        "importances": model_details(done, prep.slot_names, spark)})


def rank1_per_group(df: DataFrame, group: str, metric: str, id_col: str, higher: bool = True) -> DataFrame:
    """Row with the best ``metric`` per group, the smallest id on ties (W10 idxmax / idxmin),
    as an aggregate: best value first, then the smallest id among the rows holding it."""
    best = df.groupBy(group).agg((F.max if higher else F.min)(metric).alias("__best"))
    j = df.join(best, group).where(F.col(metric) == F.col("__best"))
    return j.groupBy(group, F.col("__best").alias(metric)).agg(F.min(id_col).alias(id_col))


def metric_ranges(board: DataFrame, metrics) -> DataFrame:
    """Min / max of each metric over the successfully trained models, NaN and NULL skipped."""
    ok = board.where("trained_successfully")
    rows = []
    for m in metrics:
        v = F.when(~F.isnan(F.col(m)), F.col(m))
        rows.append(ok.agg(F.lit(m).alias("metric"), F.min(v).alias("min"), F.max(v).alias("max"),
                           F.count(v).alias("n_models")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def top_models(board: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` rows of a ranked leaderboard."""
    return board.where(F.col("rank") <= n).orderBy("rank")


def weak_classes(report: DataFrame) -> DataFrame:
    """Per-class weakness flags (H13): recall < 0.5; precision < 0.7 and recall < 0.7 when the
    label universe has at most 10 classes."""
    k = report.agg(F.count(F.lit(1)).alias("__k"))
    j = attach(report, k)
    return j.select("label", (F.col("recall") < 0.5).alias("low_recall"),
                    ((F.col("__k") <= 10) & (F.col("precision") < 0.7) & (F.col("recall") < 0.7)).alias("weak"))


def run_report(result: TrainResult, df: DataFrame, model_id: str, target: str, started, finished=None,
               parameters: dict | None = None) -> DataFrame:
    """The run report as one typed row (timestamp, start / end time, runtime, parameters, data,
    preprocessing, models, evaluation, best model, status). Arrays inside are cut to 100
    elements and the leaderboard is embedded as JSON rows."""
    import datetime as _dt
    import json as _json
    finished = finished or _dt.datetime.now(_dt.timezone.utc)
    prep = result.prep.params
    pre = {"numeric": result.prep.numeric[:100], "categorical": result.prep.categorical[:100],
           "datetime": result.prep.datetime[:100], "dropped": result.prep.dropped[:100],
           "scaling": prep.get("scaling"), "outliers": prep.get("outliers"),
           "n_features": len(result.prep.slot_names)}
    board = [r.asDict() for r in result.leaderboard.drop("error").orderBy("rank").collect()]   # one row per model
    shape = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    row = [(finished.isoformat(), started.isoformat(), finished.isoformat(), (finished - started).total_seconds(),
            model_id, target, result.problem, {k: str(v) for k, v in (parameters or {}).items()},
            int(shape), len(df.columns), _json.dumps(pre, default=str), _json.dumps(board, default=str),
            result.best_model, "completed" if result.best_model else "failed",
            result.prep.slot_names[:100])]
    return df.sparkSession.createDataFrame(row, "timestamp string, start_time string, end_time string, "
                                                "runtime_seconds double, model_id string, target string, "
                                                "problem_type string, parameters map<string,string>, n_rows long, "
                                                "n_columns int, preprocessing string, models string, "
                                                "best_model string, status string, features array<string>")
