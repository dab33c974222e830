"""Block + halo windows equal plain per-key windows; fills and sums carry across blocks."""

import random

import numpy as np
import pytest
import pandas as pd

from pyspark.sql import functions as F

from tabforge.operators import series as S


def _events(spark, n=300, keys=3, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = float(rng.normal(10, 3))
        rows.append((i, int(rng.integers(0, keys)), int(rng.integers(0, 50)), None if i % 11 == 0 else v))
    return spark.createDataFrame(rows, "id long, k long, t long, v double")


def test_halo_blocks_match_one_block(spark):
    df = _events(spark)
    kw = dict(lags=(1, 3), windows=(4,), funcs=("mean", "std", "min", "max", "median", "sum"), diffs=(1, 2))
    small = S.series_features(df, ["v"], ["t", "id"], ["k"], block_rows=7, **kw).toPandas()
    big = S.series_features(df, ["v"], ["t", "id"], ["k"], block_rows=1 << 20, **kw).toPandas()
    a = small.sort_values("id").reset_index(drop=True)
    b = big.sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b[a.columns], check_exact=False, rtol=1e-9)


def test_against_pandas(spark):
    df = _events(spark)
    out = S.series_features(df, ["v"], ["t", "id"], ["k"], lags=(2,), windows=(3,), funcs=("mean",),
                            diffs=(1,), block_rows=5).toPandas().sort_values(["k", "t", "id"])
    pdf = df.toPandas().sort_values(["k", "t", "id"])
    g = pdf.groupby("k")["v"]
    exp_lag = g.shift(2)
    exp_roll = g.transform(lambda s: s.rolling(3).mean())
    exp_diff = g.diff(1)
    np.testing.assert_allclose(out["v_lag_2"].to_numpy(dtype=float), exp_lag.to_numpy(dtype=float), equal_nan=True)
    np.testing.assert_allclose(out["v_rolling_3_mean"].to_numpy(dtype=float), exp_roll.to_numpy(dtype=float),
                               equal_nan=True)
    np.testing.assert_allclose(out["v_diff_1"].to_numpy(dtype=float), exp_diff.to_numpy(dtype=float), equal_nan=True)


def test_fill_across_blocks(spark):
    df = _events(spark)
    out = S.fill_series(df, ["v"], ["t", "id"], ["k"], block_rows=4).toPandas().sort_values(["k", "t", "id"])
    pdf = df.toPandas().sort_values(["k", "t", "id"])
    exp = pdf.groupby("k")["v"].transform(lambda s: s.ffill().bfill()).fillna(pdf["v"].mean())
    np.testing.assert_allclose(out["v"].to_numpy(dtype=float), exp.to_numpy(dtype=float))


def test_cumsum_and_tail(spark):
    df = _events(spark).fillna(0.0)
    out = S.cumulative_sum(df, "v", ["t", "id"], ["k"], block_rows=6).toPandas().sort_values(["k", "t", "id"])
    pdf = df.toPandas().sort_values(["k", "t", "id"])
    np.testing.assert_allclose(out["v_cumsum"].to_numpy(), pdf.groupby("k")["v"].cumsum().to_numpy())
    tail = S.tail_rows(df, 5, ["t", "id"], ["k"]).toPandas()
    assert tail.groupby("k").size().max() == 5


def test_sequence_index_global_dense(spark):
    df = _events(spark, n=500)
    for group_rows in (37, 1 << 20):                      # hot-series splitting on and off
        ix = S.sequence_index(df, ["t", "id"], [], "_seq", group_rows=group_rows).toPandas()
        assert sorted(ix["_seq"]) == list(range(500))
        exp = df.toPandas().sort_values(["t", "id"])["id"].tolist()
        assert ix.sort_values("_seq")["id"].tolist() == exp


def test_sequence_index_hot_keys(spark):
    df = _events(spark, n=600, keys=3)
    ix = S.sequence_index(df, ["t", "id"], ["k"], "_seq", group_rows=25).toPandas()
    pdf = df.toPandas().sort_values(["k", "t", "id"])
    pdf["exp"] = pdf.groupby("k").cumcount()
    m = ix.merge(pdf[["id", "exp"]], on="id")
    assert (m["_seq"] == m["exp"]).all()


def test_no_single_partition_exchange(spark, monkeypatch):
    # a series longer than one numbering group must never be moved into a single partition
    monkeypatch.setattr(S, "GROUP_ROWS", 37)
    df = _events(spark)
    plan = S.series_features(df, ["v"], ["t", "id"], [], lags=(1,), windows=(3,), diffs=())._jdf \
        .queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_frequency(spark):
    import datetime as dt
    days = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i),) for i in range(30)]
    assert S.infer_frequency(spark.createDataFrame(days, "t timestamp"), "t") == "D"
    months = [(dt.datetime(2020 + i // 12, i % 12 + 1, 1),) for i in range(24)]
    assert S.infer_frequency(spark.createDataFrame(months, "t timestamp"), "t") == "MS"
    hours = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i),) for i in range(48)]
    assert S.infer_frequency(spark.createDataFrame(hours, "t timestamp"), "t") == "H"
    irregular = days[:5] + days[7:]
    assert S.infer_frequency(spark.createDataFrame(irregular, "t timestamp"), "t") is None


def test_frequency_codes_and_periods(spark):
    import datetime as dt
    weeks = [(dt.datetime(2024, 1, 7) + dt.timedelta(weeks=i),) for i in range(20)]
    assert S.infer_frequency(spark.createDataFrame(weeks, "t timestamp"), "t") == "W"
    quarters = [(dt.datetime(2020 + (3 * i) // 12, (3 * i) % 12 + 1, 1),) for i in range(12)]
    assert S.infer_frequency(spark.createDataFrame(quarters, "t timestamp"), "t") == "QS"
    month_ends = [(dt.datetime(2023, m, 1) - dt.timedelta(days=1),) for m in range(2, 13)]
    assert S.infer_frequency(spark.createDataFrame(month_ends, "t timestamp"), "t") == "M"
    assert [S.seasonal_period(f) for f in ("D", "W", "MS", "QS", "H", None, "T")] == [7, 52, 12, 4, 24, 7, 1]


def test_fill_leading_and_trailing_nulls(spark):
    rows = [(1, 0, None), (2, 1, 5.0), (3, 2, None), (4, 3, 7.0), (5, 4, None)]
    df = spark.createDataFrame(rows, "id long, t long, v double")
    out = S.fill_series(df, ["v"], ["t", "id"], block_rows=2).orderBy("t").toPandas()["v"].tolist()
    assert out == [5.0, 5.0, 5.0, 7.0, 7.0]


def test_monotonic_and_duplicates(spark):
    import datetime as dt
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i // 2)) for i in range(10)]
    df = spark.createDataFrame(rows, "seq long, ts timestamp")
    m = S.monotonic_check(df, "ts", "seq")
    assert m["increasing"] and not m["decreasing"]
    assert S.duplicate_count(df, "ts").first()[0] == 5


def test_partition_summaries_span_many_arrow_batches(spark):
    """Gap and step statistics stay exact when a partition arrives as many Arrow batches."""
    from tabforge.operators.profile import gap_stats
    rng = np.random.default_rng(11)
    vals = np.unique(rng.normal(0, 10, 3000).round(3))
    df = spark.createDataFrame([(float(v),) for v in rng.permutation(vals)], "x double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        g = gap_stats(df, "x", partitions=3)
        s = S.adjacent_stats(df.withColumn("o", F.col("x")), "o", "x", partitions=3)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    gaps = np.diff(np.sort(vals))
    assert g["n_unique"] == len(vals)
    assert g["gap_mean"] == pytest.approx(gaps.mean()) and g["gap_std"] == pytest.approx(gaps.std())
    assert s["n_down"] == 0 and s["n_up"] == len(vals) - 1
    assert s["step_min"] == pytest.approx(gaps.min()) and s["step_max"] == pytest.approx(gaps.max())


def test_many_features_by_numpy_equal_window_frames(spark, monkeypatch):
    rnd = random.Random(11)
    rows = [(i, i % 3, i // 2, None if rnd.random() < 0.03 else float("nan") if rnd.random() < 0.02 else rnd.gauss(5, 2), i % 7) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k long, t long, v double, w int")
    got = []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 9)
    try:
        for wide in (0, 10 ** 9):
            monkeypatch.setattr(S, "WIDE", wide)
            f = S.series_features(df, ["v", "w"], ["t", "id"], ["k"], lags=(1, 5), windows=(2, 4), funcs=("mean", "std", "var", "min", "max", "sum"),
                                  diffs=(1, 3), shift_cols=("v",), block_rows=20, keep_index=True)
            assert ("ArrowEvalPython" in (p := f._jdf.queryExecution().toString()) or "MapInArrow" in p) == (wide == 0)
            got.append((f.columns, {r["id"]: r for r in f.collect()}))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0][0] == got[1][0] and len(got[0][1]) == 400
    for i, a in got[0][1].items():
        b = got[1][1][i]
        for c in got[0][0]:
            assert a[c] == b[c] or (c == "v" and a[c] != a[c] and b[c] != b[c]), (i, c, a[c], b[c])
