"""Table and column profiles (shape, nulls, describe, value counts, distinct counts, ...).

Each profile is one distributed aggregate (partial aggregation map-side, a tiny
final result). Per-column results come back in long form
``(column_name, ...)`` so that any number of columns is one job, not one job
per column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from tabforge.operators.quantiles import exact_quantiles
from tabforge.session import ship_package
from tabforge.functions.scalars import attach

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


# ---------------------------------------------------------------- P1 / A8: schema only

def column_types(df: DataFrame, exclude: Sequence[str] = ()) -> dict[str, list[str]]:
    """Split columns into numeric / categorical / datetime / boolean lists (schema walk, no job)."""
    out = {"numeric": [], "categorical": [], "datetime": [], "boolean": []}
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, T.BooleanType):
            out["boolean"].append(f.name)
        elif isinstance(f.dataType, NUMERIC_TYPES):
            out["numeric"].append(f.name)
        elif isinstance(f.dataType, DATETIME_TYPES):
            out["datetime"].append(f.name)
        else:
            out["categorical"].append(f.name)
    return out


def is_numeric(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, NUMERIC_TYPES + (T.BooleanType,))


def dtype_histogram(df: DataFrame) -> DataFrame:
    """Columns per Spark type."""
    counts: dict[str, int] = {}
    for f in df.schema.fields:
        counts[f.dataType.simpleString()] = counts.get(f.dataType.simpleString(), 0) + 1
    return df.sparkSession.createDataFrame(sorted(counts.items()), "dtype string, n_columns long")


# ---------------------------------------------------------------- A1 shape

def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


# ---------------------------------------------------------------- A3 / A4 null profile

def _missing(df: DataFrame, c: str):
    col = F.col(c)
    if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: null_count, null_pct (0-100), total_rows. NaN counts as missing."""
    cols = list(cols or df.columns)
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.sum(F.when(_missing(df, c), 1).otherwise(0)).alias(f"m{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', m{i}" for i, c in enumerate(cols))
    long = agg.selectExpr("__n", f"stack({len(cols)}, {stack}) AS (column_name, null_count)")
    return long.select(
        "column_name",
        F.col("null_count").cast("long").alias("null_count"),
        F.when(F.col("__n") > 0, F.col("null_count") * 100.0 / F.col("__n")).otherwise(F.lit(0.0)).alias("null_pct"),
        F.col("__n").alias("total_rows"))


def null_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Table-level: total missing cells, % of cells, columns with any missing (A3/A4)."""
    prof = null_profile(df, cols)
    ncols = len(cols or df.columns)
    return prof.agg(F.sum("null_count").alias("total_missing"),
                    (F.sum("null_count") * 100.0 / (F.max("total_rows") * ncols)).alias("missing_pct"),
                    F.sum(F.when(F.col("null_count") > 0, 1).otherwise(0)).cast("long").alias("columns_with_missing"))


# ---------------------------------------------------------------- A2 describe

def describe(df: DataFrame, cols: Sequence[str] | None = None, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """pandas-style describe per numeric column: count, mean, std (ddof 1), min, quartiles, max.

    Moments are one aggregate; quartiles come from the distributed exact quantile operator.
    """
    cols = list(cols or column_types(df)["numeric"])
    spark = df.sparkSession
    aggs = []
    for i, c in enumerate(cols):
        v = F.when(~_missing(df, c), F.col(c).cast("double"))
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"),
                 F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    stats = {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}
    q = exact_quantiles(df, cols, probs, stats=stats)
    rows = []
    for i, c in enumerate(cols):
        rows.append((c, int(row[f"n{i}"]), row[f"a{i}"], row[f"s{i}"], row[f"lo{i}"],
                     *[q[(c, p)] for p in probs], row[f"hi{i}"]))
    qnames = [f"p{int(round(p * 100))}" for p in probs]
    schema = ("column_name string, count long, mean double, std double, min double, "
              + ", ".join(f"{n} double" for n in qnames) + ", max double")
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- A5 / A6 / A7 counts

def known(df: DataFrame, col: str):
    """The column with NaN as NULL: both are missing values."""
    c = F.col(col)
    return F.when(~F.isnan(c), c) if isinstance(df.schema[col].dataType, (T.FloatType, T.DoubleType)) else c


def value_counts(df: DataFrame, col: str, value_alias: str = "value") -> DataFrame:
    """Count and share (%) per non-null value of one column."""
    counts = df.select(known(df, col).alias(value_alias)).where(F.col(value_alias).isNotNull()).groupBy(value_alias).agg(
        F.count(F.lit(1)).alias("count"))
    # The share needs the total: a one-row aggregate joined back (broadcast of 1 row),
    # not an un-partitioned window over all groups.
    total = counts.agg(F.sum("count").alias("__total"))
    return attach(counts, total).select(
        value_alias, "count", (F.col("count") * 100.0 / F.col("__total")).alias("pct"))


def _long_strings(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), known(df, c).cast("string").alias("value"))
                      for c in cols])
    return df.select(F.inline(pairs))


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Per column number of distinct non-null values (pandas ``nunique``).

    Exact form: unpivot to (column, value) then two grouped aggregates, which spreads
    every column over all tasks instead of expanding rows once per distinct aggregate.
    """
    cols = list(cols or df.columns)
    if approx:
        agg = df.agg(*[F.approx_count_distinct(known(df, c)).alias(f"d{i}") for i, c in enumerate(cols)])
        stack = ", ".join(f"'{c}', d{i}" for i, c in enumerate(cols))
        return agg.selectExpr(f"stack({len(cols)}, {stack}) AS (column_name, n_distinct)")
    long = _long_strings(df, cols).where(F.col("value").isNotNull())
    return long.distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))


def top_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent non-null value per column and its count; ties go to the smallest value.

    Two aggregates, no join: counts per (column, value), then per column the value that
    minimises (-count, value). A column with billions of distinct values is still spread
    over all tasks by the first aggregate.
    """
    long = _long_strings(df, cols).where(F.col("value").isNotNull())
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    key = F.struct((-F.col("n")).alias("neg_n"), F.col("value").alias("v"))
    return counts.groupBy("column_name").agg(F.min(key).alias("best")).select(
        "column_name", F.col("best.v").alias("top_value"), (-F.col("best.neg_n")).alias("top_count"))


# ---------------------------------------------------------------- A9 / A10 class balance

def imbalance(df: DataFrame, target: str) -> DataFrame:
    """Class imbalance profile (A9): smallest/largest class, shares, ratio and warnings.

    Ties between equally sized classes go to the smallest class label (as string). One
    grouped count, then one aggregate over the class table (min over (count, label) and
    over (-count, label)).
    """
    counts = df.select(known(df, target).cast("string").alias("cls")).where(F.col("cls").isNotNull()).groupBy("cls") \
        .agg(F.count(F.lit(1)).alias("n"))
    agg = counts.agg(
        F.count(F.lit(1)).alias("n_classes"), F.sum("n").alias("tot"),
        F.min(F.struct(F.col("n").alias("n"), F.col("cls").alias("c"))).alias("lo"),
        F.min(F.struct((-F.col("n")).alias("n"), F.col("cls").alias("c"))).alias("hi"))
    mn, mx, tot = F.col("lo.n"), -F.col("hi.n"), F.col("tot")
    return agg.select(
        "n_classes", F.col("lo.c").alias("minority_class"), mn.alias("minority_count"),
        (mn * 100.0 / tot).alias("minority_pct"),
        F.col("hi.c").alias("majority_class"), mx.alias("majority_count"), (mx * 100.0 / tot).alias("majority_pct"),
        (mx / mn).alias("imbalance_ratio"), ((mx / mn) > 3).alias("warn_ratio"),
        ((mn * 100.0 / tot) < 10).alias("warn_minority"))


def class_entropy(df: DataFrame, target: str) -> DataFrame:
    """Natural-log class entropy, its maximum ln(k) and the normalised ratio (A10)."""
    vc = value_counts(df, target, "cls")
    p = F.col("pct") / 100.0
    return vc.agg(F.count(F.lit(1)).alias("n_classes"), F.sum(-p * F.ln(p)).alias("entropy")).select(
        "n_classes", "entropy",
        F.ln(F.col("n_classes").cast("double")).alias("max_entropy"),
        F.when(F.col("n_classes") > 1, F.col("entropy") / F.ln(F.col("n_classes").cast("double")))
        .otherwise(F.lit(1.0)).alias("normalized_entropy"),
    ).withColumn("warn_low_entropy", (F.col("normalized_entropy") < 0.7) & (F.col("n_classes") > 2))


# ---------------------------------------------------------------- A11 IQR outliers of one column

def iqr_outlier_count(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    q = exact_quantiles(df, [col], (0.25, 0.75))
    q1, q3 = q[(col, 0.25)], q[(col, 0.75)]
    iqr = q3 - q1
    lo, hi = q1 - k * iqr, q3 + k * iqr
    v = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when((v < lo) | (v > hi), 1).otherwise(0)).cast("long").alias("n_outliers"),
    ).select(F.lit(q1).alias("q1"), F.lit(q3).alias("q3"), F.lit(lo).alias("lower"), F.lit(hi).alias("upper"),
             "n_rows", "n_outliers", (F.col("n_outliers") * 100.0 / F.col("n_rows")).alias("outlier_pct"),
             ((F.col("n_outliers") * 100.0 / F.col("n_rows")) > 5).alias("warn"))


# ---------------------------------------------------------------- A12 / A13 gaps, ratios

def _gap_partials(it):
    """One summary row per partition. The partition is sorted, so its Arrow batches arrive as
    consecutive slices; the gap across each batch border is added here."""
    import numpy as np
    import pandas as pd
    n, first, last, g1, g2 = 0, None, None, 0.0, 0.0
    for pdf in it:
        v = pdf["v"].to_numpy(dtype="float64")
        if len(v) == 0:
            continue
        g = np.diff(v)
        if last is not None:
            g = np.concatenate([[v[0] - last], g])
        g1 += float(g.sum())
        g2 += float((g * g).sum())
        n += len(v)
        first = v[0] if first is None else first
        last = v[-1]
    if n:
        yield pd.DataFrame({"n": [n], "lo": [first], "hi": [last], "g1": [g1], "g2": [g2]})


def gap_stats(df: DataFrame, col: str, partitions: int | None = None) -> dict:
    """Mean and population std of gaps between sorted distinct non-null values.

    Distinct values are range-partitioned; each task sorts its slice in numpy and
    returns one partial row (count, first, last, sum of gaps, sum of squared gaps);
    the gaps across slice borders are added from those partial rows. No window over
    an unpartitioned ordering is needed, and the answer does not depend on the
    sampled range bounds.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = df.select(F.col(col).cast("double").alias("v")).where(
        F.col("v").isNotNull() & ~F.isnan("v")).distinct()
    ship_package(spark)
    ranged = distinct.repartitionByRange(parts, "v").sortWithinPartitions("v")
    rows = ranged.mapInPandas(_gap_partials, "n long, lo double, hi double, g1 double, g2 double").collect()
    rows = sorted(rows, key=lambda r: r["lo"])
    n = sum(r["n"] for r in rows)
    g1 = sum(r["g1"] for r in rows)
    g2 = sum(r["g2"] for r in rows)
    for a, b in zip(rows, rows[1:]):
        g = b["lo"] - a["hi"]
        g1 += g
        g2 += g * g
    if n < 2:
        return {"n_unique": n, "gap_mean": None, "gap_std": None, "gap_ratio": None}
    mean = g1 / (n - 1)
    std = math.sqrt(max(g2 / (n - 1) - mean * mean, 0.0))
    return {"n_unique": n, "gap_mean": mean, "gap_std": std,
            "gap_ratio": (std / mean) if mean != 0 else float("inf")}


def unique_profile(df: DataFrame, col: str) -> DataFrame:
    """n_unique (NULL and NaN counted as one value, like pandas ``unique``), ratio and value range of the others."""
    c = known(df, col)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(c).alias("nd"),
                  F.max(F.when(c.isNull(), 1).otherwise(0)).alias("has_null"),
                  F.min(c).cast("double").alias("vmin"), F.max(c).cast("double").alias("vmax")).select(
        "n_rows", (F.col("nd") + F.col("has_null")).alias("n_unique"),
        ((F.col("nd") + F.col("has_null")) / F.col("n_rows")).alias("unique_ratio"),
        (F.col("vmax") - F.col("vmin")).alias("value_range"))
