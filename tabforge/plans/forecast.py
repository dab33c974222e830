"""Forecasting plan (F14, F18, M22, M23, H6), many series in parallel.

* features: calendar + lag / rolling / diff per series (leakage-safe for the target:
  its rolling frames and differences end one row before the predicted row);
* rows with incomplete warm-up features dropped, then a chronological split at the
  timestamp boundary of the first 80 % of the remaining rows (the split is applied
  after the drop);
* feature models (linear, ridge, random forest, gradient boosting) on min-max scaled
  features -- the target itself is never scaled, so every RMSE is in target units;
* ARIMA(1,1,1) per series by Hannan-Rissanen (long AR on the differences, then OLS of
  the difference on its lag and the lagged innovation), fitted with per-series Gram
  aggregates and evaluated with the closed-form multi-step forecast;
* the best model (lowest test RMSE) forecasts ``horizon`` future steps recursively from a
  bounded per-series state (the last rows needed by the longest look-back).
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.feature import MinMaxScaler, RobustScaler, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, functions as F, types as T

from tabforge.functions import dates as D
from tabforge.operators import models as MD
from tabforge.operators import prepare as R
from tabforge.operators import series as S
from tabforge.operators.profile import column_types
from tabforge.operators.timefeatures import ts_calendar_columns, ts_features
from tabforge.session import Written, cut_lineage, ship_package, spread

FORECAST_MODELS = ("random_forest", "gradient_boosting", "linear_regression", "ridge")
AR_ORDER = 5                     # long-AR order of the Hannan-Rissanen first stage


@dataclass
class ForecastResult:
    leaderboard: DataFrame
    best_model: str | None
    test_predictions: DataFrame
    future: DataFrame | None
    arima: DataFrame | None
    freq: str
    extra: dict = field(default_factory=dict)


def _solve_rows(it, p: int):
    """Solve per-series normal equations from Gram rows (runs in tasks, one row per series)."""
    import numpy as np
    for pdf in it:
        out = []
        for _, r in pdf.iterrows():
            xtx = np.array(r["xtx"], dtype=float).reshape(p, p)
            xty = np.array(r["xty"], dtype=float)
            try:
                beta = np.linalg.solve(xtx, xty)
            except np.linalg.LinAlgError:
                beta = np.linalg.lstsq(xtx, xty, rcond=None)[0]
            out.append(beta.tolist())
        pdf = pdf.drop(columns=["xtx", "xty"])
        pdf["beta"] = out
        yield pdf


def per_series_ols(df: DataFrame, keys, y: str, xs: list[str], intercept: bool = True) -> DataFrame:
    """OLS per series from one grouped Gram aggregate; the small per-series systems are
    solved inside tasks (mapInPandas over the Gram table)."""
    cols = ([F.lit(1.0)] if intercept else []) + [F.col(x) for x in xs]
    p = len(cols)
    cond = F.col(y).isNotNull()
    for x in xs:
        cond = cond & F.col(x).isNotNull()
    data = df.where(cond)
    xtx = [F.sum(a * b) for a in cols for b in cols]
    xty = [F.sum(a * F.col(y)) for a in cols]
    g = data.groupBy(*keys).agg(F.array(*xtx).alias("xtx"), F.array(*xty).alias("xty"), F.count(F.lit(1)).alias("n_obs"))
    ship_package(df.sparkSession)
    schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + ["n_obs long", "beta array<double>"])
    return g.mapInPandas(lambda it: _solve_rows(it, p), schema)


def _by_series(df: DataFrame, per_series: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join per-series values onto rows; a single unkeyed series gets them as literals."""
    if keys:
        return df.join(per_series, list(keys), how)
    from tabforge.functions.scalars import attach
    return attach(df, per_series)


def arima111(df: DataFrame, ts: str, target: str, keys, id_col: str | None, split_col: str = "split",
             m: int = AR_ORDER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hannan-Rissanen ARIMA(1,1,1) per series on the train rows; returns (coefficients,
    test predictions with the closed-form multi-step forecast from the last train row, and the
    coefficients with the state at the last row of all, from which ``arima_future`` goes on)."""
    keys = list(keys)
    order = [ts] + ([id_col] if id_col else [])
    ix = S.sequence_index(df, order, keys, "_i")
    feats = S.series_features(ix, [target], order, keys, lags=(1,), windows=(), diffs=(1,), indexed=ix,
                              idx_col="_i", keep_index=True)
    d = feats.withColumn("dy", F.col(f"{target}_diff_1"))
    # lags of the difference: dy_{t-j} = y_{t-j} - y_{t-j-1}
    dl = S.series_features(d.select(*keys, "_i", "dy", split_col, target, ts, *([id_col] if id_col and id_col not in keys else [])),
                           ["dy"], ["_i"], keys, lags=tuple(range(1, m + 1)), windows=(), diffs=(),
                           indexed=d.select(*keys, "_i", "dy", split_col, target, ts,
                                            *([id_col] if id_col and id_col not in keys else [])),
                           idx_col="_i", keep_index=True)
    dl = cut_lineage(dl)
    train = dl.where(F.col(split_col) == "train")
    xs = [f"dy_lag_{j}" for j in range(1, m + 1)]
    ar = per_series_ols(train, keys, "dy", xs)
    ar_b = ar.select(*keys, F.col("beta").alias("ar"))
    res = _by_series(dl, ar_b, keys, "left").withColumn(
        "e", F.col("dy") - F.col("ar")[0] - sum(F.col("ar")[j] * F.col(f"dy_lag_{j}") for j in range(1, m + 1)))
    res = S.series_features(res.select(*keys, "_i", "dy", "dy_lag_1", "e", split_col, target, ts),
                            ["e"], ["_i"], keys, lags=(1,), windows=(), diffs=(),
                            indexed=res.select(*keys, "_i", "dy", "dy_lag_1", "e", split_col, target, ts),
                            idx_col="_i", keep_index=True)
    res = cut_lineage(res)
    hr = per_series_ols(res.where(F.col(split_col) == "train"), keys, "dy", ["dy_lag_1", "e_lag_1"])
    coef = hr.select(*keys, "n_obs", F.col("beta")[0].alias("c"), F.col("beta")[1].alias("phi"),
                     F.col("beta")[2].alias("theta"))
    # state at the last train row of each series
    def state(rows):
        return _by_series(coef, rows.groupBy(*keys).agg(
            F.max("_i").alias("_T"), F.max(ts).alias("_last"), F.max_by(F.col(target), F.col("_i")).alias("yT"),
            F.max_by(F.col("dy"), F.col("_i")).alias("dyT"), F.max_by(F.col("e"), F.col("_i")).alias("eT")), keys)
    st = state(res.where(F.col(split_col) == "train")).drop("_last")
    test = _by_series(res.where(F.col(split_col) == "test").select(*keys, "_i", ts, target), st, keys)
    pred = _ahead((F.col("_i") - F.col("_T")).cast("double"))
    out = test.select(*keys, ts, F.col(target).alias("actual"), pred.alias("prediction"))
    return coef, out, state(res)


def _ahead(h):
    """Forecast ``h`` steps after a state in closed form."""
    phi = F.col("phi")
    a1 = F.col("c") + phi * F.coalesce(F.col("dyT"), F.lit(0.0)) + F.col("theta") * F.coalesce(F.col("eT"), F.lit(0.0))
    near1 = F.abs(1 - phi) < 1e-9
    s_h = F.when(near1, h).otherwise((1 - F.pow(phi, h)) / (1 - phi))
    sum_s = F.when(near1, h * (h - 1) / 2).otherwise((h - s_h) / (1 - phi))
    return F.col("yT") + F.col("c") * sum_s + a1 * s_h


def arima_future(state: DataFrame, ts: str, keys, horizon: int, freq: str) -> DataFrame:
    """(keys, ts, step, forecast): ``horizon`` steps of every series after its last row."""
    kind = state.schema["_last"].dataType
    steps = state.select("*", F.posexplode(D.future_dates(F.col("_last"), freq, horizon)).alias("_p", "_at"))
    return steps.select(*keys, F.col("_at").cast(kind).alias(ts), (F.col("_p") + 1).alias("step"),
                        _ahead((F.col("_p") + 1).cast("double")).alias("forecast"))


def forecast(df: DataFrame, ts: str, target: str, key_cols=(), id_col: str | None = None, horizon: int = 7,
             test_size: float = 0.2, lags=(1, 7, 14, 30), windows=(7, 14, 30), models=FORECAST_MODELS,
             arima: bool = True, scale: str = "minmax", freq: str | None = None, parallelism: int = 4) -> ForecastResult:
    keys = list(key_cols)
    base = df.where(F.col(ts).isNotNull())
    order = [ts] + ([id_col] if id_col else [])
    if base.where(F.col(target).isNull()).limit(1).count():
        base = S.fill_series(base, [target], order, keys)            # W5 fill of target gaps
    freq = freq or S.infer_frequency(base, ts) or "D"
    feats = ts_features(base, ts, None, keys, id_col, lags, windows, leakage_safe_cols=[target])
    feat_cols = [c for c in column_types(feats, [target, *keys, *( [id_col] if id_col else [])])["numeric"]
                 if c != target]
    # P5: warm-up rows out; what follows reads some of these columns many times
    feats = Written(feats.dropna(subset=feat_cols + [target]).select(
        *dict.fromkeys([*keys, ts, *([id_col] if id_col else []), target, *feat_cols]))).df
    split = R.split_chronological(feats, ts, id_col or ts, 1 - test_size)
    vec = VectorAssembler(inputCols=feat_cols, outputCol="raw", handleInvalid="keep")
    scalers = {"minmax": MinMaxScaler, "standard": lambda **k: StandardScaler(withMean=True, **k),
               "robust": lambda **k: RobustScaler(withCentering=True, **k)}
    if scale not in (None, "none", *scalers):
        raise ValueError(f"unknown scale method {scale!r}")
    scaler = scalers[scale](inputCol="raw", outputCol="features") if scale in scalers else None
    prep = Pipeline(stages=[vec] + ([scaler] if scaler else [])).fit(split.where("split = 'train'"))
    data = prep.transform(split)
    if scaler is None:
        data = data.withColumnRenamed("raw", "features")
    # the models need the vector only, not the hundreds of columns it was made of
    data = data.select(*keys, ts, "split", "features", F.col(target).cast("double").alias("label"))
    data = spread(data).persist(StorageLevel.MEMORY_AND_DISK)
    train = data.where("split = 'train'")
    st = train.agg(F.stddev_pop("label").alias("sd"), F.count(F.lit(1)).alias("n")).first()
    rows, preds, fitted = [], None, {}

    def one(item):
        order_i, name = item
        t0 = time.time()
        try:
            m = MD.fit(MD.regression_estimator(name, None, st["sd"] or 1.0, st["n"]), train, st["n"], len(feat_cols))
            p = m.transform(data.where("split = 'test'")).select(*keys, ts, F.col("label").alias("actual"), "prediction")
            r = p.agg(F.sqrt(F.avg((F.col("actual") - F.col("prediction")) ** 2)).alias("rmse"),
                      F.avg(F.abs(F.col("actual") - F.col("prediction"))).alias("mae")).first()
            return (name, order_i, True, None, time.time() - t0, r["rmse"], r["mae"]), m, p.withColumn("model", F.lit(name))
        except Exception as e:  # noqa: BLE001 - failure isolation (H12)
            return (name, order_i, False, f"{type(e).__name__}: {e}", time.time() - t0, None, None), None, None

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        for row, m, p in ex.map(one, enumerate(models)):
            rows.append(row)
            if m is not None:
                fitted[row[0]] = m
                preds = p if preds is None else preds.unionByName(p)
    coef = arima_state = None
    if arima:
        t0 = time.time()
        try:
            coef, ap, arima_state = arima111(base.join(split.select(*keys, ts, *([id_col] if id_col and id_col not in keys else []), "split"),
                                          [*keys, ts] + ([id_col] if id_col and id_col not in keys else []), "left")
                                .fillna({"split": "train"}), ts, target, keys, id_col)
            ap = ap.where(F.col("prediction").isNotNull())
            r = ap.agg(F.sqrt(F.avg((F.col("actual") - F.col("prediction")) ** 2)).alias("rmse"),
                       F.avg(F.abs(F.col("actual") - F.col("prediction"))).alias("mae")).first()
            rows.append(("arima", len(models), True, None, time.time() - t0, r["rmse"], r["mae"]))
            ap = ap.withColumn("model", F.lit("arima"))
            preds = ap if preds is None else preds.unionByName(ap)
        except Exception as e:  # noqa: BLE001
            rows.append(("arima", len(models), False, f"{type(e).__name__}: {e}", time.time() - t0, None, None))
    spark = df.sparkSession
    board = spark.createDataFrame(rows, "model string, model_order int, trained_successfully boolean, error string, "
                                        "train_seconds double, rmse double, mae double")
    best = board.where("trained_successfully AND rmse IS NOT NULL").orderBy("rmse", "model_order").first()
    best_name = best["model"] if best else None
    future = None
    if best_name == "arima":
        future = arima_future(arima_state, ts, keys, horizon, freq)
    elif best_name in fitted:
        future = recursive_forecast(base, ts, target, keys, id_col, fitted[best_name], prep, feat_cols, lags,
                                    windows, horizon, freq)
    return ForecastResult(board, best_name, preds, future, coef, freq, {"features": feat_cols})


def _next_features(batches, cols, target, need: int, lags, windows, feat_cols, passed):
    """Features of every series' next row from the last ``need`` values of its columns (``_h0`` and so on) and those of the row itself."""
    import numpy as np
    import pyarrow as pa
    for batch in batches:
        made, n = {}, batch.num_rows
        for i, c in enumerate(cols):
            last = batch.column(f"_h{i}").flatten().to_numpy(zero_copy_only=False).reshape(n, need)
            now = batch.column(f"_x{i}").to_numpy(zero_copy_only=False)

            def past(k):
                return last[:, need - k] if k else now
            made[c] = now
            with np.errstate(all="ignore"):
                for name, values, ok in S.frames(past, lambda k: ~np.isnan(past(k)), c, c == target, lags, windows, S.FRAME_FUNCS, (1, 7)):
                    made[name] = np.where(ok, values, np.nan)
        whole = np.all([~np.isnan(made[c]) for c in feat_cols], axis=0) if feat_cols else np.ones(n, dtype=bool)
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in passed] + [pa.array(made[c]) for c in feat_cols] + [pa.array(whole)],
                                         names=[*passed, *feat_cols, "_whole"])


def recursive_forecast(base: DataFrame, ts: str, target: str, keys, id_col, model, prep, feat_cols, lags, windows,
                       horizon: int, freq: str) -> DataFrame:
    """Forecast ``horizon`` steps per series. The state is one row a series with the last max(lag, window) + 2 values
    (bounded) of every column that features look back at; each step computes the features of the next row from it, predicts it and
    appends it, without a shuffle, and cuts lineage. A series shorter than the longest look-back lacks features; its
    forecasts are NULL."""
    keys = list(keys)
    need = max([*lags, *windows, 8]) + 2
    order = [ts] + ([id_col] if id_col else [])
    own = column_types(base, [*keys, *order])["numeric"]
    calendar = {c: e for c, e in ts_calendar_columns(ts, "hour_sin" in feat_cols).items() if c != "is_weekend"}
    cols = [*own, *calendar]
    hist = [f"_h{i}" for i in range(len(cols))]
    values = [F.col(c) for c in own] + list(calendar.values())
    rows = F.sort_array(F.collect_list(F.struct(*order, *[v.cast("double").alias(h) for v, h in zip(values, hist)])))
    state = S.tail_rows(base, need, order, keys).groupBy(*keys).agg(F.max(ts).alias("_last"), rows.alias("_rows"))

    def padded(h):
        short = F.transform("_rows", lambda r: r[h])
        return F.concat(F.array_repeat(F.lit(None).cast("double"), need - F.size(short)), short)
    state = cut_lineage(state.select(*keys, "_last", *[padded(h).alias(h) for h in hist]))
    ship_package(base.sparkSession)
    step = D.future_dates(F.col("_last"), freq, 1)[0].cast(base.schema[ts].dataType)
    passed = [*keys, ts, *hist, *[f"_x{i}" for i in range(len(cols))]]
    feat_cols, lags, windows = list(feat_cols), tuple(lags), tuple(windows)
    out = None
    for s in range(1, horizon + 1):
        # the columns of the next row: calendar columns of its own, the target unknown, others as in the last row
        now = [F.lit(None) if c == target else F.element_at(h, -1) if c in own else calendar[c] for c, h in zip(cols, hist)]
        nxt = state.select(*keys, step.alias(ts), *hist).select("*", *[v.cast("double").alias(f"_x{i}") for i, v in enumerate(now)])
        f = nxt.select(*passed).mapInArrow(
            lambda it: _next_features(it, cols, target, need, lags, windows, feat_cols, passed),
            T.StructType([nxt.schema[c] for c in passed] + [T.StructField(c, T.DoubleType()) for c in feat_cols]
                         + [T.StructField("_whole", T.BooleanType())]))
        pred = F.when(F.col("_whole"), F.col("prediction"))
        scored = model.transform(prep.transform(f)).select(
            *keys, ts, pred.alias("forecast"),
            *[F.concat(F.slice(h, 2, need - 1), F.array(pred if c == target else F.col(f"_x{i}"))).alias(h)
              for i, (c, h) in enumerate(zip(cols, hist))])
        scored = cut_lineage(scored)
        state = scored.select(*keys, F.col(ts).alias("_last"), *hist)
        o = scored.select(*keys, ts, F.lit(s).alias("step"), "forecast")
        out = o if out is None else out.unionByName(o)
    return out
