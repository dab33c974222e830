"""Training and forecasting on small tables whose answers can be computed by hand."""

import json
import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F


def points(spark, classes, n=240):
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        c = i % classes
        rows.append((i, f"c{c}", c + rnd.gauss(0, 0.7), rnd.gauss(0, 1), str(date(2024, 1, 1) + timedelta(days=i)), str(1000 + c)))
    return spark.createDataFrame(rows, "id long, label string, x double, y double, day string, code string")


def test_binary_leaderboard_against_counts(spark):
    from tabforge.plans.train import train_classification
    res = train_classification(points(spark, 2).drop("day", "code"), "label", ["id"], models=("logistic_regression", "svm"), balance="weights",
                               primary_metric="f1")
    board = {r["model"]: r for r in res.leaderboard.collect()}
    assert res.extra["primary_metric"] == "f1_binary" and all(r["trained_successfully"] for r in board.values())
    te = res.predictions.where("split = 'test' and model = 'logistic_regression'").collect()
    tp = sum(r["actual"] == r["predicted"] == "c1" for r in te)
    fp = sum(r["actual"] == "c0" and r["predicted"] == "c1" for r in te)
    fn = sum(r["actual"] == "c1" and r["predicted"] == "c0" for r in te)
    tn = len(te) - tp - fp - fn
    lr = board["logistic_regression"]
    assert lr["precision_binary"] == pytest.approx(tp / (tp + fp)) and lr["recall_binary"] == pytest.approx(tp / (tp + fn))
    assert lr["mcc"] == pytest.approx((tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    p = [r["positive_score"] if r["actual"] == "c1" else 1 - r["positive_score"] for r in te]
    assert lr["log_loss"] == pytest.approx(-sum(map(math.log, p)) / len(p))
    assert 0.5 < lr["roc_auc"] <= 1 and 0.5 < lr["average_precision"] <= 1 and lr["baseline_improvement_pct"] == 0
    assert board["svm"]["log_loss"] is None and board["svm"]["roc_auc"] is None and board["svm"]["accuracy"] > 0.5
    assert json.loads(lr["complexity"])["n_coef"] == 2
    assert {r["model"] for r in res.extra["importances"].collect()} == {"logistic_regression", "svm"}


def test_three_classes_with_weights_through_one_vs_rest(spark):
    from tabforge.plans.train import train_classification
    res = train_classification(points(spark, 3).drop("day", "code"), "label", ["id"], models=("gradient_boosting",), balance="weights",
                               params={"gradient_boosting": {"n_estimators": 3}}, primary_metric="auc")
    row = res.leaderboard.first()
    assert row["trained_successfully"], row["error"]
    assert res.extra["primary_metric"] == "accuracy" and row["precision_binary"] is None and row["f1_macro"] > 0.4
    assert json.loads(row["complexity"])["n_classifiers"] == 3
    with pytest.raises(ValueError):
        train_classification(points(spark, 3), "label", ["id"], models=("naive_bayes",), primary_metric="no such")


def test_searched_candidates_stand_on_the_leaderboard(spark):
    from tabforge.plans.train import train_regression
    res = train_regression(points(spark, 2).drop("day", "code"), "y", ["id"], models=("linear_regression", "ridge"),
                           search={"models": ["ridge"], "n_iter": 2, "cv": 2}, primary_metric="rmse")
    board = {r["model"]: r for r in res.leaderboard.collect()}
    assert set(board) == {"linear_regression", "ridge", "ridge_optimized"} and "ridge_optimized" in res.models
    base = board["linear_regression"]["rmse"]
    for r in board.values():
        assert r["baseline_improvement_pct"] == pytest.approx((base - r["rmse"]) / base * 100)
    assert res.extra["search"].count() == 1


def test_search_of_a_classifier_uses_stratified_folds(spark):
    from pyspark.ml.feature import VectorAssembler
    from tabforge.plans.search import random_search
    # 4 of 40 rows have the rare class: every one of 4 folds holds one of them, in training three
    df = spark.createDataFrame([(i, float(i % 7), float(i < 4)) for i in range(40)], "id long, x double, label double")
    table, models = random_search(VectorAssembler(inputCols=["x"], outputCol="features").transform(df), "classification", ["id"],
                                  models=["logistic_regression"], n_iter=1, cv=4)
    assert table.count() == 1 and set(models) == {"logistic_regression_optimized"}
    # accuracy of the frequent class in folds of 9 and 1
    assert table.first()["best_cv_score"] == pytest.approx(0.9) and table.first()["best_fold_std"] == pytest.approx(0.0)


def test_string_dates_become_date_features(spark):
    from tabforge.plans.prepare import fit_preparation
    df = points(spark, 2).withColumn("day", F.when(F.col("id") == 7, F.lit(None)).otherwise(F.col("day")))
    prep = fit_preparation(df, "y", None, exclude=["id"])
    assert prep.datetime == ["day"] and set(prep.categorical) == {"label", "code"} and "day_month" in prep.slot_names
    assert prep.model.transform(df).count() == df.count()
    late = df.withColumn("day", F.when(F.col("id") == 200, F.lit("soon")).otherwise(F.col("day")))
    assert "day" in fit_preparation(late, "y", None, exclude=["id"]).categorical


def test_arima_forecasts_where_it_is_best(spark):
    from tabforge.plans.forecast import forecast
    rows = [(k, date(2024, 1, 1) + timedelta(days=i), 10.0 * k + i + math.sin(i)) for k in (1, 2) for i in range(90)]
    df = spark.createDataFrame(rows, "k int, day date, v double")
    res = forecast(df, "day", "v", ["k"], horizon=3, models=(), lags=(1,), windows=(7,))
    assert res.best_model == "arima"
    got = res.future.orderBy("k", "step").collect()
    assert [(r["k"], r["step"], r["day"]) for r in got] == [
        (k, s, date(2024, 1, 1) + timedelta(days=89 + s)) for k in (1, 2) for s in (1, 2, 3)]
    assert all(abs(r["forecast"] - (10 * r["k"] + 89 + r["step"])) < 5 for r in got)


def test_short_series_has_no_invented_forecast(spark):
    from tabforge.plans.forecast import forecast
    rows = [(k, date(2024, 1, 1) + timedelta(days=i), 10.0 * k + i % 7) for k, n in ((1, 80), (2, 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, day date, v double")
    res = forecast(df, "day", "v", ["k"], horizon=2, models=("linear_regression",), arima=False, lags=(1,), windows=(7,))
    got = {(r["k"], r["step"]): r["forecast"] for r in res.future.collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert got[1, 1] is not None and got[1, 2] is not None and got[2, 1] is None and got[2, 2] is None


def test_chronological_split_by_string_ids_and_without_ids(spark):
    from tabforge.operators.prepare import split_chronological
    rows = [(date(2024, 1, 1 + i // 4), f"k{9 - i}", i) for i in range(10)]
    df = spark.createDataFrame(rows, "day date, id string, n int")
    got = {r["id"] for r in split_chronological(df, "day", "id", 0.5).where("split = 'train'").collect()}
    assert got == {"k9", "k8", "k7", "k6", "k2"}
    got = {r["n"] for r in split_chronological(df, "day", "day", 0.5).where("split = 'train'").collect()}
    assert got == {0, 1, 2, 3}


def test_training_rows_are_dealt_out(spark):
    """A file of one partition would train on one core; small tables stay as they are."""
    from tabforge.plans.train import train_regression
    from tabforge.session import FEW_ROWS, spread
    big = spark.range(0, 3 * FEW_ROWS, 1, 1).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("y"))
    res = train_regression(big, "y", ["id"], models=("ridge",))
    features = res.extra["features"]
    sizes = features.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 3 and max(r["count"] for r in sizes) < 1.1 * FEW_ROWS
    assert features.count() == 3 * FEW_ROWS
    res.release()
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == 1


def test_forecast_steps_by_hand_in_a_few_jobs(spark):
    """Each step computed all features of the state anew by windows, in some twenty jobs a step."""
    from tabforge.plans.forecast import recursive_forecast

    class Same:
        def transform(self, df):
            return df

    class Sum:
        def transform(self, df):
            return df.withColumn("prediction", sum(F.col(c) for c in used))
    used = ["v_lag_2", "u_rolling_7_mean", "v_diff_1", "day_of_month", "day_of_month_lag_1", "v_rolling_7_max", "u"]
    series = {k: [(date(2024, 1, 1) + timedelta(days=i), 10.0 * k + i % 7, float(i * i)) for i in range(n)] for k, n in ((1, 60), (2, 8), (3, 7))}
    df = spark.createDataFrame([(k, *r) for k, rows in series.items() for r in rows], "k int, day date, v double, u double")
    jobs = []
    for h in (1, 4):
        spark.sparkContext.setJobGroup(f"steps-{h}", "")
        out = recursive_forecast(df, "day", "v", ["k"], None, Sum(), Same(), used, (1, 2), (7,), h, "D")
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"steps-{h}")))
    assert jobs[1] - jobs[0] <= 3 * 4
    got = {(r["k"], r["step"]): (r["day"], r["forecast"]) for r in out.collect()}
    assert len(got) == 12 and all(got[3, s][1] is not None for s in (1, 2, 3, 4))
    for k, rows in series.items():
        v, u = [r[1] for r in rows], [r[2] for r in rows]
        for s in range(1, 5):
            day = rows[-1][0] + timedelta(days=s)
            u.append(u[-1])
            v.append(v[-2] + sum(u[-7:]) / 7 + v[-1] - v[-2] + day.day + (day - timedelta(days=1)).day + max(v[-7:]) + u[-1])
            assert got[k, s] == (day, pytest.approx(v[-1]))


@pytest.mark.parametrize("target", ["label", "y"])
def test_rows_are_read_a_few_times(spark, target):
    """Every fit of the preparation read the table and split it anew."""
    from tabforge.plans.train import train_classification, train_regression
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x
    df = points(spark, 2).drop("day", "code").withColumn("y", F.udf(seen, "double")("y")).repartition(2)
    train = train_classification if target == "label" else train_regression
    res = train(df, target, ["id"], models=("random_forest",), params={"random_forest": {"n_estimators": 2}})
    assert res.best_model == "random_forest" and read.value <= 240 * 10
    res.release()
