"""Datetime features (F17), time-series features (F18) and datetime-string detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabforge.functions import dates as D
from tabforge.operators import series as S
from tabforge.operators.profile import column_types


def has_time_of_day(df: DataFrame, cols: Sequence[str]) -> dict[str, bool]:
    """Per datetime column: does any value have hour > 0 (one aggregate for all columns)."""
    if not cols:
        return {}
    row = df.agg(*[F.max(F.hour(F.col(c))).alias(f"h{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"h{i}"] or 0) > 0 for i, c in enumerate(cols)}


def datetime_feature_columns(df: DataFrame, cols: Sequence[str], date_features: bool = True,
                             cyclic_features: bool = True, ref_dates: dict | None = None,
                             hour_flags: dict | None = None) -> dict:
    """Column expressions of the datetime feature set for each column in ``cols``; the
    hour / minute columns and the hour cycle only where a value has hour > 0."""
    flags = hour_flags if hour_flags is not None else has_time_of_day(df, cols)
    out = {}
    for c in cols:
        sql = D.datetime_feature_sql(c, flags.get(c, False), date_features, cyclic_features, ref_dates)
        out.update({k: F.expr(v) for k, v in sql.items()})
    return out


def datetime_features(df: DataFrame, cols: Sequence[str] | None = None, date_features: bool = True,
                      cyclic_features: bool = True, ref_dates: dict | None = None,
                      drop_source: bool = False) -> DataFrame:
    """Add ``{c}_year, _month, _day, _dayofweek (Mon=0), _dayofyear, _quarter[, _hour, _minute],
    _is_weekend, _is_month_end``, cyclic sin/cos, ``_days_from_{ref}`` and ``_days_from_epoch``."""
    cols = list(cols if cols is not None else column_types(df)["datetime"])
    exprs = datetime_feature_columns(df, cols, date_features, cyclic_features, ref_dates)
    out = df.select("*", *[e.alias(k) for k, e in exprs.items()])
    return out.drop(*cols) if drop_source else out


def ts_calendar_columns(ts: str, with_hour: bool) -> dict:
    """Calendar columns of the time-series feature set (names without a column prefix)."""
    t = F.col(ts)
    two_pi = 2 * 3.141592653589793
    out = {
        "day_of_week": F.weekday(t).cast("long"), "day_of_month": F.dayofmonth(t).cast("long"),
        "day_of_year": F.dayofyear(t).cast("long"), "month": F.month(t).cast("long"),
        "quarter": F.quarter(t).cast("long"), "year": F.year(t).cast("long"),
        "is_weekend": F.weekday(t) >= 5,
        "day_of_week_sin": F.sin(two_pi * F.weekday(t) / 7), "day_of_week_cos": F.cos(two_pi * F.weekday(t) / 7),
        "month_sin": F.sin(two_pi * F.month(t) / 12), "month_cos": F.cos(two_pi * F.month(t) / 12),
    }
    if with_hour:
        out["hour_sin"] = F.sin(two_pi * F.hour(t) / 24)
        out["hour_cos"] = F.cos(two_pi * F.hour(t) / 24)
    return out


def ts_features(df: DataFrame, ts_col: str, value_cols: Sequence[str] | None = None,
                key_cols: Sequence[str] = (), id_col: str | None = None,
                lags=(1, 7, 14, 30), windows=(7, 14, 30), funcs=("mean", "std", "min", "max"),
                diffs=(1, 7), calendar: bool = True, leakage_safe_cols: Sequence[str] = (),
                block_rows: int = 1 << 20, with_hour: bool | None = None) -> DataFrame:
    """Time-series feature set (F18): calendar and cyclic columns, then lag / rolling / diff
    over every numeric column -- including the calendar columns just added (``is_weekend`` is
    boolean and excluded) -- per series key in (ts, id) order. ``with_hour`` says whether there are hour columns;
    None looks for a time of day in the rows."""
    keys = list(key_cols)
    order = [ts_col] + ([id_col] if id_col else [])
    base = df
    if calendar:
        if with_hour is None:
            with_hour = has_time_of_day(df, [ts_col])[ts_col]
        cal = ts_calendar_columns(ts_col, with_hour)
        base = df.select("*", *[e.alias(k) for k, e in cal.items()])
    if value_cols is None:
        skip = set(keys) | ({id_col} if id_col else set())
        value_cols = [c for c in column_types(base)["numeric"] if c not in skip]
    return S.series_features(base, value_cols, order, keys, lags, windows, funcs, diffs,
                             block_rows=block_rows, shift_cols=leakage_safe_cols)


def detect_datetime_strings(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per string column: is every non-null value parseable as a timestamp (P3)? One aggregate."""
    cols = list(cols if cols is not None else column_types(df)["categorical"])
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(F.col(c)).alias(f"n{i}"), F.count(F.try_to_timestamp(F.col(c))).alias(f"p{i}")]
    row = df.agg(*aggs)
    stack = ", ".join(f"'{c}', n{i}, p{i}" for i, c in enumerate(cols))
    return row.selectExpr(f"stack({len(cols)}, {stack}) AS (column_name, n_values, n_parsed)") \
              .withColumn("is_datetime", (F.col("n_values") > 0) & (F.col("n_values") == F.col("n_parsed")))


def date_strings(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """The string columns in which every value is a date or time (P3); plain numbers are none. The first rows
    rule out most columns cheaply, and those that are left are checked over all rows."""
    left = list(cols)
    for rows in (df.limit(100), df):
        if left:
            marked = rows.select(*[F.when(F.col(c).isNull() | F.col(c).rlike("[-/:]"), F.col(c)).otherwise(F.lit("")).alias(c)
                                   for c in left])
            found = {r["column_name"]: r for r in detect_datetime_strings(marked, left).collect()}
            left = [c for c in left if found[c]["n_values"] == found[c]["n_parsed"]]
    return [c for c in left if found[c]["is_datetime"]]
