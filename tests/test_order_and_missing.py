"""Order statistics in a column's own type, NaN as missing, frequencies with a multiplier, k-NN in training and search."""

import datetime as dt
import decimal
import random

import pytest
from pyspark.sql import functions as F

from tabforge.operators import prepare as R
from tabforge.operators import profile as P
from tabforge.operators import series as S


def test_value_at_place_in_its_own_type(spark):
    rnd = random.Random(8)
    big = [2 ** 60 + rnd.randrange(40) for _ in range(60)] + [-2 ** 61 - i for i in range(9)] + [-1, 0, 1]
    texts = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(16))) for _ in range(60)] + ["same prefix, then %d" % i for i in range(9)]
    decimals = [decimal.Decimal(rnd.randrange(-10 ** 20, 10 ** 20)).scaleb(-4) for _ in range(30)]
    for kind, values, key in (("long", big, None), ("string", texts, lambda t: t.encode()), ("decimal(24,4)", decimals, None)):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], f"v {kind}")
        want = sorted(values, key=key)
        for r in (len(values) // 2, len(values) - 1):
            assert R.value_at(df, "v", r) == want[r]


def test_chronological_split_of_ids_that_doubles_confuse(spark):
    base = 2 ** 60
    rows = [(dt.datetime(2024, 1, 1), base + i) for i in range(100)]
    df = spark.createDataFrame(rows, "ts timestamp, id long").repartition(5)
    got = {r["id"]: r["split"] for r in R.split_chronological(df, "ts", "id", 0.8).collect()}
    assert [got[base + i] for i in range(100)] == ["train"] * 80 + ["test"] * 20


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float(i % 9) if i % 10 else float("nan"),) for i in range(100)] + [(None,)], "v double")
    assert {r["value"]: r["count"] for r in P.value_counts(df, "v").collect()} == {float(v): sum(1 for i in range(100) if i % 10 and i % 9 == v) for v in range(9)}
    assert P.distinct_counts(df, ["v"]).first()["n_distinct"] == 9
    assert P.top_values(df, ["v"]).first()["top_value"] != "NaN"
    assert P.imbalance(df, "v").first()["n_classes"] == 9
    r = P.unique_profile(df, "v").first()
    assert r["n_unique"] == 10 and r["value_range"] == 8.0


@pytest.mark.parametrize("step,code", [(dt.timedelta(minutes=15), "15T"), (dt.timedelta(seconds=90), "90S"),
                                       (dt.timedelta(days=14), "2W")])
def test_frequency_with_a_multiplier(spark, step, code):
    start = dt.datetime(2024, 1, 3, 5)
    df = spark.createDataFrame([(start + step * i,) for i in range(30)], "ts timestamp_ntz")
    assert S.infer_frequency(df, "ts") == code
    got = [r["ts"] for r in S.future_dates(df, "ts", [], code, 3).orderBy("step").collect()]
    assert got == [start + step * (29 + i) for i in (1, 2, 3)]


def test_calendar_frequency_with_a_multiplier(spark):
    months = [dt.datetime(2020 + (2 * i) // 12, (2 * i) % 12 + 1, 1) for i in range(12)]
    assert S.infer_frequency(spark.createDataFrame([(m,) for m in months], "ts timestamp_ntz"), "ts") == "2MS"
    odd = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m),) for m in (0, 15, 30, 50)], "ts timestamp_ntz")
    assert S.infer_frequency(odd, "ts") is None


def test_knn_and_one_vs_rest_in_training_and_search(spark, monkeypatch):
    from tabforge.plans import search
    from tabforge.plans.train import train_classification
    monkeypatch.setitem(search.CLASSIFICATION_GRIDS, "gradient_boosting", {
        "n_estimators": [2], "learning_rate": [0.1], "max_depth": [2], "min_samples_split": [2], "subsample": [1.0]})
    monkeypatch.setitem(search.CLASSIFICATION_GRIDS, "knn", {"n_neighbors": [3, 5], "weights": ["distance"], "p": [2]})
    rnd = random.Random(1)
    rows = [(i, i // 2, rnd.gauss(3.0 * (i % 3), 0.5), rnd.gauss(2.0 * (i % 3), 0.5), "abc"[i % 3]) for i in range(240)]
    df = spark.createDataFrame(rows, "a long, b long, x double, y double, label string")
    res = train_classification(df, "label", ["a", "b"], models=("knn",), params={"knn": {"n_neighbors": 3, "weights": "distance", "p": 1}},
                               search={"models": ["knn", "gradient_boosting"], "n_iter": 2, "cv": 2})
    board = {r["model"]: r for r in res.leaderboard.collect()}
    assert set(board) == {"knn", "knn_optimized", "gradient_boosting_optimized"}
    assert all(r["trained_successfully"] and r["accuracy"] > 0.9 for r in board.values())
    assert res.predictions.where("model = 'knn'").select(F.min("prediction_probability") >= 0, F.max("prediction_probability") <= 1).first() == (True, True)
    assert res.extra["search"].count() == 2
    res.release()
