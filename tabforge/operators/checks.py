"""Input checks (P6-P13, V4): every check is a row ``(check, status, value)`` of a
DataFrame built from one aggregate over the table, never a Python loop over rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from tabforge.operators.profile import NUMERIC_TYPES, column_types

# Column names that mark an identifier, and the UUID shape (lower-case hex).
ID_NAMES = ("id", "uuid", "guid", "identifier", "key", "row_id", "index")
UUID_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

CHECK_SCHEMA = "check string, status string, value string"


def _rows(spark, rows):
    return spark.createDataFrame(rows, CHECK_SCHEMA)


def validation_checks(df: DataFrame, target: str | None, problem: str, min_per_class: int = 1) -> DataFrame:
    """Pre-training checks. ``error`` rows mean training must stop; ``warn`` rows are advisories.

    regression: target exists, table not empty, target numeric, target not all missing.
    classification: target exists, table not empty, >= 2 classes, missing targets counted.
    clustering: table not empty; small-table (<10 rows) and wide-table (>100 columns) advisories.
    """
    spark = df.sparkSession
    ncols = len(df.columns)
    rows = []
    if problem != "clustering":
        exists = target in df.columns
        rows.append(("target_exists", "pass" if exists else "error", str(exists).lower()))
        if not exists:
            return _rows(spark, rows)
    aggs = [F.count(F.lit(1)).alias("n")]
    if target:
        tcol = F.col(target)
        if isinstance(df.schema[target].dataType, (T.FloatType, T.DoubleType)):
            tcol = F.when(~F.isnan(tcol), tcol)
        aggs += [F.count(tcol).alias("nt"), F.count_distinct(tcol).alias("nd")]
    r = df.agg(*aggs).first()
    n = r["n"]
    rows.append(("dataset_not_empty", "pass" if n > 0 else "error", str(n)))
    rows.append(("n_rows_at_least_10", "pass" if n >= 10 else "warn", str(n)))
    rows.append(("n_columns_at_most_100", "pass" if ncols <= 100 else "warn", str(ncols)))
    if target:
        numeric = isinstance(df.schema[target].dataType, NUMERIC_TYPES + (T.BooleanType,))
        missing = n - r["nt"]
        rows.append(("missing_in_target", "pass" if missing == 0 else "warn", str(missing)))
        if problem in ("regression", "time_series"):
            rows.append(("target_is_numeric", "pass" if numeric else "error", str(numeric).lower()))
            rows.append(("target_has_values", "pass" if r["nt"] > 0 else "error", str(r["nt"])))
        if problem == "classification":
            rows.append(("has_multiple_classes", "pass" if r["nd"] >= 2 else "error", str(r["nd"])))
            if r["nd"] >= 2:
                smallest = (df.where(F.col(target).isNotNull()).groupBy(target).count()
                            .agg(F.min("count")).first()[0])
                rows.append(("min_class_count", "pass" if smallest >= min_per_class else "warn", str(smallest)))
    return _rows(spark, rows)


def id_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Identifier detector (P10): all values distinct with more than 10 rows, or any value
    shaped like a lower-case UUID (string columns), or a name like an id. First rule wins."""
    cols = list(cols or df.columns)
    strings = set(column_types(df)["categorical"])
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        aggs.append(F.count_distinct(F.col(c)).alias(f"d{i}"))
        aggs.append(F.max(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(f"z{i}"))
        if c in strings:
            aggs.append(F.max(F.when(F.col(c).rlike(UUID_PATTERN), 1).otherwise(0)).alias(f"u{i}"))
        else:
            aggs.append(F.lit(0).alias(f"u{i}"))
    row = df.agg(*aggs)
    stack = ", ".join(f"'{c}', d{i} + z{i}, u{i}" for i, c in enumerate(cols))
    long = row.selectExpr("n", f"stack({len(cols)}, {stack}) AS (column_name, n_unique, has_uuid)")
    all_unique = (F.col("n_unique") == F.col("n")) & (F.col("n") > 10)
    uuid = F.col("has_uuid") == 1
    named = F.lower(F.col("column_name")).isin(*ID_NAMES)
    reason = (F.when(all_unique, F.lit("all_unique")).when(uuid, F.lit("uuid_values"))
              .when(named, F.lit("id_name")))
    return long.select("column_name", F.col("n_unique").cast("long").alias("n_unique"),
                       reason.alias("reason"), reason.isNotNull().alias("is_identifier"))


def high_cardinality(df: DataFrame, threshold: int = 100, cols: Sequence[str] | None = None) -> DataFrame:
    """Categorical columns with more than ``threshold`` distinct values."""
    from tabforge.operators.profile import distinct_counts
    cols = list(cols or column_types(df)["categorical"])
    return distinct_counts(df, cols).withColumn("high_cardinality", F.col("n_distinct") > threshold)


def high_missing(df: DataFrame, threshold_pct: float = 25.0, cols: Sequence[str] | None = None) -> DataFrame:
    """Columns whose missing share exceeds ``threshold_pct`` (P12; 25 for numeric
    features, 10 for time-series features)."""
    from tabforge.operators.profile import null_profile
    cols = list(cols or column_types(df)["numeric"])
    return null_profile(df, cols).withColumn("high_missing", F.col("null_pct") > threshold_pct)


def unexpected_classes(train: DataFrame, score: DataFrame, target: str) -> DataFrame:
    """Target values of the scoring table never seen in training, compared as strings."""
    seen = train.select(F.col(target).cast("string").alias("label")).distinct()
    new = score.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("label"))
    return new.join(seen, "label", "left_anti").groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))


def _kind(dt) -> str:
    if isinstance(dt, NUMERIC_TYPES + (T.BooleanType,)):
        return "numeric"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "categorical"


def schema_checks(train_schema: T.StructType, score: DataFrame, target: str | None = None) -> DataFrame:
    """Required / extra / type-compatibility checks of a scoring table.

    Missing feature columns are errors, extra columns warnings, and a numeric column
    arriving as non-numeric (or the reverse) an error."""
    rows = []
    want = {f.name: f.dataType for f in train_schema.fields if f.name != target}
    have = {f.name: f.dataType for f in score.schema.fields}
    for c in want:
        if c not in have:
            rows.append(("missing_column", c, "error", _kind(want[c])))
        elif _kind(want[c]) != _kind(have[c]):
            rows.append(("type_mismatch", c, "error", f"{_kind(want[c])}->{_kind(have[c])}"))
    for c in have:
        if c not in want and c != target:
            rows.append(("extra_column", c, "warn", _kind(have[c])))
    return score.sparkSession.createDataFrame(rows, "check string, column_name string, status string, detail string")


def scoring_report(train_schema: T.StructType, score: DataFrame, target: str | None,
                   train_classes: DataFrame | None = None) -> DataFrame:
    """Scoring-input validation (V4): schema checks, missing values and unseen classes in one
    table with a final ``passed`` row (no error rows)."""
    spark = score.sparkSession
    sc = schema_checks(train_schema, score, target).select(
        F.concat_ws(":", "check", "column_name").alias("check"), "status", F.col("detail").alias("value"))
    from tabforge.operators.profile import null_profile
    nulls = null_profile(score).where("null_count > 0").select(
        F.concat(F.lit("missing_values:"), F.col("column_name")).alias("check"), F.lit("warn").alias("status"),
        F.col("null_count").cast("string").alias("value"))
    parts = sc.unionByName(nulls)
    if train_classes is not None and target and target in score.columns:
        unseen = score.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("label")) \
                      .join(train_classes.select(F.col("label").cast("string")), "label", "left_anti") \
                      .groupBy("label").count().select(
            F.concat(F.lit("unexpected_class:"), F.col("label")).alias("check"), F.lit("warn").alias("status"),
            F.col("count").cast("string").alias("value"))
        parts = parts.unionByName(unseen)
    errors = parts.agg(F.sum(F.when(F.col("status") == "error", 1).otherwise(0)).alias("e"))
    passed = errors.select(F.lit("passed").alias("check"),
                           F.when(F.coalesce(F.col("e"), F.lit(0)) == 0, F.lit("pass")).otherwise(F.lit("error")).alias("status"),
                           F.coalesce(F.col("e"), F.lit(0)).cast("string").alias("value"))
    return parts.unionByName(passed)
