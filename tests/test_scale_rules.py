"""No hidden limits, NaN as missing, and plans that stay linear."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabforge.functions.dates import future_dates
from tabforge.operators.models import GaussianNB
from tabforge.operators.neighbors import dbscan
from tabforge.operators.prepare import apply_outliers, fit_categories, outlier_counts
from tabforge.operators.profile import iqr_outlier_count
from tabforge.operators.quantiles import exact_quantiles
from tabforge.operators.series import fill_series


def test_quantiles_of_any_spread(spark):
    rng = np.random.default_rng(1)
    data = {"x": np.exp(rng.uniform(-300, 300, 20000)) * rng.choice([-1, 1], 20000), "y": rng.normal(size=20000), "z": rng.normal(size=20000)}
    data["y"][0], data["z"][:3], data["z"][3] = np.inf, -np.inf, np.inf
    got = exact_quantiles(spark.createDataFrame(pd.DataFrame(data)), list(data), (0.1, 0.5, 0.9), final_rows=50)
    for c, v in data.items():
        for p in (0.1, 0.5, 0.9):
            assert abs(got[c, p] - np.quantile(v, p)) <= 1e-9 * abs(np.quantile(v, p))


def test_fill_is_linear_and_takes_nan_as_missing(spark):
    n = 120_000
    v = np.where(np.arange(n) % 3 == 1, np.arange(n, dtype=float), np.nan)
    out = fill_series(spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "v": v})), ["v"], ["i"]).orderBy("i").toPandas()
    assert np.array_equal(out["v"], pd.Series(v).ffill().bfill())


def test_naive_bayes_of_many_classes(spark):
    rows = pd.DataFrame({"a": np.repeat(np.arange(60) * 10.0, 20) + np.tile(np.linspace(-1, 1, 20), 60), "c": np.repeat(np.arange(60), 20)})
    df = spark.createDataFrame(rows)
    assert GaussianNB(["a"], "c").fit(df).transform(df).where("prediction <> c").count() == 0


def test_dbscan_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(450)], "id long, x array<double>")
    assert dbscan(df, "id", "x", 1.5, 2).select("cluster").distinct().count() == 1


def test_nan_is_no_outlier(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(100)] + [(float("nan"),)] * 10 + [(None,)], "v double")
    assert iqr_outlier_count(df, "v").first()["n_outliers"] == 0
    assert outlier_counts(df, {"v": (0.0, 9.0)}).first()["n_outliers"] == 0
    assert apply_outliers(df, {"v": (0.0, 9.0)}).where(F.isnan("v")).count() == 10


def test_every_category_is_kept(spark):
    assert len(fit_categories(spark.range(12_000).select(F.col("id").cast("string").alias("g")), ["g"])["g"]) == 12_000


def test_future_dates(spark):
    def after(day, freq, n=3):
        row = spark.createDataFrame([(dt.datetime.fromisoformat(day),)], "t timestamp_ntz").select(future_dates(F.col("t"), freq, n)).first()[0]
        return [x.isoformat() for x in row]
    assert after("2024-02-29T06:00:00", "M") == ["2024-03-31T06:00:00", "2024-04-30T06:00:00", "2024-05-31T06:00:00"]
    assert after("2024-02-10", "M", 2) == ["2024-02-29T00:00:00", "2024-03-31T00:00:00"]
    assert after("2024-03-31", "Q", 2) == ["2024-06-30T00:00:00", "2024-09-30T00:00:00"]
    assert after("2024-03-07", "B", 4) == ["2024-03-08T00:00:00", "2024-03-11T00:00:00", "2024-03-12T00:00:00", "2024-03-13T00:00:00"]
    assert after("2024-03-09", "B", 1) == ["2024-03-11T00:00:00"]
    assert after("2024-03-01", "15T", 2) == ["2024-03-01T00:15:00", "2024-03-01T00:30:00"]
    assert after("2024-02-28", "D", 2) == ["2024-02-29T00:00:00", "2024-03-01T00:00:00"]
    assert after("2023-12-31", "A", 2) == ["2024-12-31T00:00:00", "2025-12-31T00:00:00"]
