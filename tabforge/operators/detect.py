"""Problem-type detection (F19) as a decision list over a few aggregates.

Order of the rules (defaults: max 20 classes, 3 rows per class, 10 rows for a series):

1. no target -> clustering; unknown target -> error.
2. string target whose every class has >= 3 rows -> classification.
3. numeric target, a datetime column exists, >= 10 rows, and the first datetime column is
   monotone (either direction, non-strict) in the table's sequence order -> time_series.
4. numeric target with exactly 2 distinct values (NULL counts as a value) -> classification.
5. points: classification +1 if the gaps between sorted distinct values have
   std_pop / mean < 0.1, +1 if unique ratio < 0.01; regression +1 if unique ratio > 0.3,
   +1 if range > 100 and unique ratio > 0.1.
6. more classification points and <= 20 distinct values -> classification; numeric -> regression.
7. anything else -> classification.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabforge.operators.profile import column_types, gap_stats, is_numeric
from tabforge.operators.series import monotonic_check

MAX_CLASSES = 20          # fixed values: detection defaults
MIN_PER_CLASS = 3
MIN_SERIES_ROWS = 10


def detect_problem_type(df: DataFrame, target: str | None, seq_col: str | None = None,
                        max_classes: int = MAX_CLASSES, min_per_class: int = MIN_PER_CLASS,
                        min_series_rows: int = MIN_SERIES_ROWS) -> dict:
    """Return ``{"problem_type": ..., "reason": ...}`` plus the statistics used.

    ``seq_col`` names the column that holds stored row order (DataFrames have none);
    without it the time-series rule cannot apply.
    """
    if not target:
        return {"problem_type": "clustering", "reason": "no target"}
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    numeric = is_numeric(df, target)
    t = F.col(target)
    if not numeric:
        stats = (df.where(t.isNotNull()).groupBy(t).agg(F.count(F.lit(1)).alias("n"))
                 .agg(F.min("n").alias("min_n"), F.count(F.lit(1)).alias("k")).first())
        if stats["k"] > 0 and stats["min_n"] >= min_per_class:
            return {"problem_type": "classification", "reason": "categorical target"}
    dt_cols = [c for c in column_types(df)["datetime"] if c != target]
    if numeric and dt_cols and seq_col:
        n = df.count()
        if n >= min_series_rows:
            mono = monotonic_check(df, dt_cols[0], seq_col)
            if mono["monotonic"]:
                return {"problem_type": "time_series", "reason": f"monotone {dt_cols[0]}"}
    if numeric:
        tv = F.col(target).cast("double")
        r = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(tv).alias("nd"),
                   F.max(F.when(tv.isNull() | F.isnan(tv), 1).otherwise(0)).alias("has_null"),
                   F.min(F.when(~F.isnan(tv), tv)).alias("mn"), F.max(F.when(~F.isnan(tv), tv)).alias("mx")).first()
        n_unique = r["nd"] + r["has_null"]
        ratio = n_unique / r["n"]
        if n_unique == 2:
            return {"problem_type": "classification", "reason": "two values", "n_unique": n_unique}
        cls_pts = reg_pts = 0
        if n_unique > 1 and not r["has_null"]:
            g = gap_stats(df, target)
            if g["gap_ratio"] is not None and g["gap_ratio"] < 0.1:
                cls_pts += 1
        if ratio < 0.01:
            cls_pts += 1
        if ratio > 0.3:
            reg_pts += 1
        rng = (r["mx"] - r["mn"]) if r["mx"] is not None else 0.0
        if rng > 100 and ratio > 0.1:
            reg_pts += 1
        if cls_pts > reg_pts and n_unique <= max_classes:
            return {"problem_type": "classification", "reason": "class indicators", "n_unique": n_unique}
        return {"problem_type": "regression", "reason": "numeric target", "n_unique": n_unique}
    return {"problem_type": "classification", "reason": "non-numeric target"}


def detection_table(df: DataFrame, target: str | None, seq_col: str | None = None, label: str = "") -> DataFrame:
    d = detect_problem_type(df, target, seq_col)
    return df.sparkSession.createDataFrame([(label, target or "", d["problem_type"])],
                                           "table_name string, target string, problem_type string")
