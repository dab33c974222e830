"""Registered queries (one per operator of the inventory) and their DuckDB oracles.

Each query reads the driver's tables at ``sf_dir`` -- whole tables, no row caps -- and
returns a DataFrame whose column names match the oracle SQL. Floats are rounded to a
fixed number of decimals on both sides so that summation order cannot change a hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabforge.operators import checks as C
from tabforge.operators import detect as DT
from tabforge.operators import metrics as M
from tabforge.operators import prepare as R
from tabforge.operators import profile as P
from tabforge.operators import series as S
from tabforge.operators import timefeatures as TF
from tabforge.sources import io as IO

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return IO.read_table(spark, f"{sf}/{name}.parquet")


def rnd(df: DataFrame, digits: int = 6, **per_col: int) -> DataFrame:
    """Round every float column (per-column digits override the default)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name), per_col.get(f.name, digits)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# ------------------------------------------------------------------ shared derived inputs

def events_gaps(spark, sf):
    """events with missing values derived from the data: value missing for error and view
    events, props missing for click events."""
    e = t(spark, sf, "events")
    return e.withColumn("value", F.when(F.col("event_type").isin("error", "view"), F.lit(None)).otherwise(F.col("value"))) \
            .withColumn("props", F.when(F.col("event_type") == "click", F.lit(None)).otherwise(F.col("props")))


EVENTS_GAPS_SQL = """(SELECT event_id, ts, user_id, event_type,
  CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE value END AS value,
  CASE WHEN event_type = 'click' THEN NULL ELSE props END AS props FROM events)"""

HASH_UNIT_SQL = "(CAST(('0x' || substr(md5(concat_ws('|', '42', CAST({id} AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0)"
HASH_FRAC_SQL = "(CAST(('0x' || substr(md5(concat_ws('|', '42', CAST({id} AS VARCHAR))), 1, 13)) AS BIGINT) / 4503599627370496.0)"


# ------------------------------------------------------------------ A1-A13 profiles

@query("table_shape", "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM lineitem")
def q_table_shape(spark, sf):
    return P.table_shape(t(spark, sf, "lineitem"))


def _null_sql(cols_types):
    parts = []
    for c, is_float in cols_types:
        miss = f"{c} IS NULL OR isnan({c})" if is_float else f"{c} IS NULL"
        parts.append(f"SELECT '{c}' AS column_name, CAST(sum(CASE WHEN {miss} THEN 1 ELSE 0 END) AS BIGINT) AS null_count, "
                     f"round(sum(CASE WHEN {miss} THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS null_pct, "
                     f"count(*) AS total_rows FROM {EVENTS_GAPS_SQL}")
    return "\nUNION ALL\n".join(parts)


EVENT_COLS = [("event_id", False), ("ts", False), ("user_id", False), ("event_type", False), ("value", True),
              ("props", False)]


@query("null_profile", _null_sql(EVENT_COLS))
def q_null_profile(spark, sf):
    return rnd(P.null_profile(events_gaps(spark, sf)))


@query("null_summary", f"""
SELECT CAST(sum(nv + np) AS BIGINT) AS total_missing, round(sum(nv + np) * 100.0 / (count(*) * 6), 6) AS missing_pct,
       CAST((CASE WHEN sum(nv) > 0 THEN 1 ELSE 0 END) + (CASE WHEN sum(np) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS columns_with_missing
FROM (SELECT CASE WHEN value IS NULL OR isnan(value) THEN 1 ELSE 0 END AS nv,
             CASE WHEN props IS NULL THEN 1 ELSE 0 END AS np FROM {EVENTS_GAPS_SQL})""")
def q_null_summary(spark, sf):
    return rnd(P.null_summary(events_gaps(spark, sf)))


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_numeric", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
    f"round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
    f"round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM lineitem" for c in LI_NUM))
def q_describe(spark, sf):
    return rnd(P.describe(t(spark, sf, "lineitem"), LI_NUM), mean=4, std=4)


@query("value_counts", """
SELECT event_type AS value, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM events WHERE event_type IS NOT NULL GROUP BY event_type""")
def q_value_counts(spark, sf):
    return rnd(P.value_counts(t(spark, sf, "events"), "event_type"))


CUST_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("distinct_counts", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM customer" for c in CUST_COLS))
def q_distinct_counts(spark, sf):
    return P.distinct_counts(t(spark, sf, "customer"), CUST_COLS)


PART_STR = ["p_name", "p_brand", "p_type"]


@query("top_value", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, min(v) AS top_value, max(n) AS top_count FROM (
  SELECT v, n, max(n) OVER () AS m FROM (SELECT {c} AS v, count(*) AS n FROM part WHERE {c} IS NOT NULL GROUP BY {c}))
WHERE n = m""" for c in PART_STR))
def q_top_value(spark, sf):
    return P.top_values(t(spark, sf, "part"), PART_STR)


# The same profiles where NaN stands for some values: a missing value like NULL, as in SQL without those rows.
NAN_SIZE_SQL = "(SELECT CASE WHEN p_size % 7 = 0 OR p_size % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS v FROM part)"


def _nan_sizes(spark, sf):
    size = F.col("p_size")
    return t(spark, sf, "part").select(F.when(size % 7 == 0, float("nan")).when(size % 5 == 0, None).otherwise(size.cast("double")).alias("v"))


@query("value_counts_nan", f"""
SELECT v AS value, count(*) AS "count", round(count(*) * 100.0 / (SELECT count(v) FROM {NAN_SIZE_SQL}), 6) AS pct
FROM {NAN_SIZE_SQL} WHERE v IS NOT NULL GROUP BY v""")
def q_value_counts_nan(spark, sf):
    return rnd(P.value_counts(_nan_sizes(spark, sf), "v"))


@query("distinct_counts_nan", f"SELECT 'v' AS column_name, count(DISTINCT v) AS n_distinct FROM {NAN_SIZE_SQL}")
def q_distinct_counts_nan(spark, sf):
    return P.distinct_counts(_nan_sizes(spark, sf), ["v"])


@query("top_value_nan", f"""
WITH c AS (SELECT CAST(v AS VARCHAR) AS v, count(*) AS n FROM {NAN_SIZE_SQL} WHERE v IS NOT NULL GROUP BY v)
SELECT 'v' AS column_name, min(v) AS top_value, max(n) AS top_count FROM c WHERE n = (SELECT max(n) FROM c)""")
def q_top_value_nan(spark, sf):
    return P.top_values(_nan_sizes(spark, sf), ["v"])


@query("imbalance_nan", f"""
WITH c AS (SELECT CAST(v AS VARCHAR) AS v, count(*) AS n FROM {NAN_SIZE_SQL} WHERE v IS NOT NULL GROUP BY v)
SELECT count(*) AS n_classes, min(n) AS minority_count, max(n) AS majority_count,
  (SELECT min(v) FROM c WHERE n = (SELECT min(n) FROM c)) AS minority_class FROM c""")
def q_imbalance_nan(spark, sf):
    return P.imbalance(_nan_sizes(spark, sf), "v").select("n_classes", "minority_count", "majority_count", "minority_class")


@query("unique_profile_nan", f"""
SELECT count(*) AS n_rows, count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS n_unique,
  max(v) - min(v) AS value_range FROM {NAN_SIZE_SQL}""")
def q_unique_profile_nan(spark, sf):
    return P.unique_profile(_nan_sizes(spark, sf), "v").select("n_rows", F.col("n_unique").cast("long").alias("n_unique"), "value_range")


@query("freq_infer_step", """
WITH s AS (SELECT DISTINCT o_orderdate AS d FROM orders),
b AS (SELECT min(d) AS d0, count(*) AS n FROM s)
SELECT i AS step, d0 + INTERVAL 15 MINUTE * (n - 1 + i) AS ts, '15T' AS freq FROM b, range(1, 4) r(i)""")
def q_freq_infer_step(spark, sf):
    first = t(spark, sf, "orders").select("o_orderdate").distinct()
    n = first.agg(F.min("o_orderdate").alias("d0"), F.count(F.lit(1)).alias("n"))
    quarters = n.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"), "d0").select(
        F.expr("timestampadd(MINUTE, cast(15 * i as int), d0)").alias("ts"))
    freq = S.infer_frequency(quarters, "ts")
    return S.future_dates(quarters, "ts", [], freq, 3).select(F.col("step").cast("long").alias("step"), "ts", F.lit(freq).alias("freq"))


@query("imbalance", """
WITH vc AS (SELECT CAST(quality AS VARCHAR) AS cls, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1),
ext AS (SELECT min(n) AS mn, max(n) AS mx, sum(n) AS tot, count(*) AS k FROM vc)
SELECT k AS n_classes,
  (SELECT min(cls) FROM vc WHERE n = mn) AS minority_class, mn AS minority_count, round(mn * 100.0 / tot, 6) AS minority_pct,
  (SELECT min(cls) FROM vc WHERE n = mx) AS majority_class, mx AS majority_count, round(mx * 100.0 / tot, 6) AS majority_pct,
  round(mx * 1.0 / mn, 6) AS imbalance_ratio, mx * 1.0 / mn > 3 AS warn_ratio, mn * 100.0 / tot < 10 AS warn_minority
FROM ext""")
def q_imbalance(spark, sf):
    return rnd(P.imbalance(t(spark, sf, "labels"), "quality"))


@query("class_entropy", """
WITH vc AS (SELECT event_type, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM events WHERE event_type IS NOT NULL GROUP BY 1)
SELECT count(*) AS n_classes, round(sum(-p * ln(p)), 6) AS entropy, round(ln(count(*)), 6) AS max_entropy,
  round(CASE WHEN count(*) > 1 THEN sum(-p * ln(p)) / ln(count(*)) ELSE 1.0 END, 6) AS normalized_entropy,
  (CASE WHEN count(*) > 1 THEN sum(-p * ln(p)) / ln(count(*)) ELSE 1.0 END) < 0.7 AND count(*) > 2 AS warn_low_entropy
FROM vc""")
def q_class_entropy(spark, sf):
    return rnd(P.class_entropy(t(spark, sf, "events"), "event_type"))


@query("iqr_outliers", """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders),
b AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT round(q1, 6) AS q1, round(q3, 6) AS q3, round(lo, 6) AS lower, round(hi, 6) AS upper, count(*) AS n_rows,
  CAST(sum(CASE WHEN o_totalprice < lo OR o_totalprice > hi THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers,
  round(sum(CASE WHEN o_totalprice < lo OR o_totalprice > hi THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS outlier_pct,
  sum(CASE WHEN o_totalprice < lo OR o_totalprice > hi THEN 1 ELSE 0 END) * 100.0 / count(*) > 5 AS warn
FROM orders, b GROUP BY q1, q3, lo, hi""")
def q_iqr_outliers(spark, sf):
    return rnd(P.iqr_outlier_count(t(spark, sf, "orders"), "o_totalprice"))


@query("gap_regularity", """
WITH d AS (SELECT DISTINCT CAST(p_retailprice AS DOUBLE) AS v FROM part WHERE p_retailprice IS NOT NULL),
g AS (SELECT v - lag(v) OVER (ORDER BY v) AS gap FROM d)
SELECT (SELECT count(*) FROM d) AS n_unique, round(avg(gap), 6) AS gap_mean, round(stddev_pop(gap), 6) AS gap_std,
       round(stddev_pop(gap) / avg(gap), 6) AS gap_ratio FROM g WHERE gap IS NOT NULL""")
def q_gap_regularity(spark, sf):
    part = t(spark, sf, "part")
    g = P.gap_stats(part, "p_retailprice")
    base = part.agg(F.count_distinct("p_retailprice").alias("n_unique"))
    return rnd(base.select("n_unique", F.lit(g["gap_mean"]).alias("gap_mean"), F.lit(g["gap_std"]).alias("gap_std"),
                           F.lit(g["gap_ratio"]).alias("gap_ratio")))


@query("unique_profile", """
SELECT count(*) AS n_rows, count(DISTINCT p_retailprice) + max(CASE WHEN p_retailprice IS NULL THEN 1 ELSE 0 END) AS n_unique,
  round((count(DISTINCT p_retailprice) + max(CASE WHEN p_retailprice IS NULL THEN 1 ELSE 0 END)) * 1.0 / count(*), 6) AS unique_ratio,
  round(max(p_retailprice) - min(p_retailprice), 6) AS value_range FROM part""")
def q_unique_profile(spark, sf):
    return rnd(P.unique_profile(t(spark, sf, "part"), "p_retailprice")).withColumn("n_unique", F.col("n_unique").cast("long"))


# ------------------------------------------------------------------ P3, P6-P13 checks

ORDERS_STR_SQL = "(SELECT o_orderkey, o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate_str FROM orders)"


@query("datetime_strings", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n_values, count(try_cast({c} AS TIMESTAMP)) AS n_parsed, "
    f"count({c}) > 0 AND count({c}) = count(try_cast({c} AS TIMESTAMP)) AS is_datetime FROM {ORDERS_STR_SQL}"
    for c in ["o_orderstatus", "o_orderpriority", "o_orderdate_str"]))
def q_datetime_strings(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority",
                                     F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate_str"))
    return TF.detect_datetime_strings(o, ["o_orderstatus", "o_orderpriority", "o_orderdate_str"])


def _id_sql():
    parts = []
    strings = {"c_name", "c_mktsegment"}
    for c in CUST_COLS:
        uu = (f"max(CASE WHEN regexp_matches({c}, '{C.UUID_PATTERN}') THEN 1 ELSE 0 END)" if c in strings else "0")
        nu = f"(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END))"
        named = "TRUE" if c.lower() in C.ID_NAMES else "FALSE"
        reason = (f"CASE WHEN {nu} = count(*) AND count(*) > 10 THEN 'all_unique' WHEN {uu} = 1 THEN 'uuid_values' "
                  f"WHEN {named} THEN 'id_name' END")
        parts.append(f"SELECT '{c}' AS column_name, CAST({nu} AS BIGINT) AS n_unique, {reason} AS reason, "
                     f"({reason}) IS NOT NULL AS is_identifier FROM customer")
    return "\nUNION ALL\n".join(parts)


@query("id_columns", _id_sql())
def q_id_columns(spark, sf):
    return C.id_columns(t(spark, sf, "customer"), CUST_COLS)


@query("high_cardinality", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) > 100 AS high_cardinality FROM customer"
    for c in ["c_name", "c_mktsegment"]))
def q_high_cardinality(spark, sf):
    return C.high_cardinality(t(spark, sf, "customer"), 100, ["c_name", "c_mktsegment"])


@query("high_missing")
def q_high_missing(spark, sf):
    return rnd(C.high_missing(events_gaps(spark, sf), 25.0, ["event_id", "user_id", "value"]))


def _high_missing_sql():
    parts = []
    for c, is_float in [("event_id", False), ("user_id", False), ("value", True)]:
        miss = f"{c} IS NULL OR isnan({c})" if is_float else f"{c} IS NULL"
        pct = f"sum(CASE WHEN {miss} THEN 1 ELSE 0 END) * 100.0 / count(*)"
        parts.append(f"SELECT '{c}' AS column_name, CAST(sum(CASE WHEN {miss} THEN 1 ELSE 0 END) AS BIGINT) AS null_count, "
                     f"round({pct}, 6) AS null_pct, count(*) AS total_rows, {pct} > 25 AS high_missing FROM {EVENTS_GAPS_SQL}")
    return "\nUNION ALL\n".join(parts)


ORACLE["high_missing"] = _high_missing_sql()


@query("checks_regression", """
SELECT * FROM (VALUES ('target_exists', 'pass', 'true')) v("check", status, value)
UNION ALL SELECT 'dataset_not_empty', CASE WHEN count(*) > 0 THEN 'pass' ELSE 'error' END, CAST(count(*) AS VARCHAR) FROM orders
UNION ALL SELECT 'n_rows_at_least_10', CASE WHEN count(*) >= 10 THEN 'pass' ELSE 'warn' END, CAST(count(*) AS VARCHAR) FROM orders
UNION ALL SELECT 'n_columns_at_most_100', 'pass', '6'
UNION ALL SELECT 'missing_in_target', CASE WHEN count(*) = count(o_totalprice) THEN 'pass' ELSE 'warn' END,
  CAST(count(*) - count(o_totalprice) AS VARCHAR) FROM orders
UNION ALL SELECT 'target_is_numeric', 'pass', 'true'
UNION ALL SELECT 'target_has_values', CASE WHEN count(o_totalprice) > 0 THEN 'pass' ELSE 'error' END,
  CAST(count(o_totalprice) AS VARCHAR) FROM orders""")
def q_checks_regression(spark, sf):
    return C.validation_checks(t(spark, sf, "orders"), "o_totalprice", "regression")


@query("checks_classification", """
SELECT * FROM (VALUES ('target_exists', 'pass', 'true')) v("check", status, value)
UNION ALL SELECT 'dataset_not_empty', CASE WHEN count(*) > 0 THEN 'pass' ELSE 'error' END, CAST(count(*) AS VARCHAR) FROM orders
UNION ALL SELECT 'n_rows_at_least_10', CASE WHEN count(*) >= 10 THEN 'pass' ELSE 'warn' END, CAST(count(*) AS VARCHAR) FROM orders
UNION ALL SELECT 'n_columns_at_most_100', 'pass', '6'
UNION ALL SELECT 'missing_in_target', CASE WHEN count(*) = count(o_orderstatus) THEN 'pass' ELSE 'warn' END,
  CAST(count(*) - count(o_orderstatus) AS VARCHAR) FROM orders
UNION ALL SELECT 'has_multiple_classes', CASE WHEN count(DISTINCT o_orderstatus) >= 2 THEN 'pass' ELSE 'error' END,
  CAST(count(DISTINCT o_orderstatus) AS VARCHAR) FROM orders
UNION ALL SELECT 'min_class_count', CASE WHEN min(n) >= 1 THEN 'pass' ELSE 'warn' END, CAST(min(n) AS VARCHAR)
  FROM (SELECT count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus)""")
def q_checks_classification(spark, sf):
    return C.validation_checks(t(spark, sf, "orders"), "o_orderstatus", "classification")


@query("unexpected_classes", f"""
SELECT l_returnflag AS label, count(*) AS n_rows FROM lineitem
WHERE l_returnflag IS NOT NULL AND l_returnflag NOT IN (SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL)
GROUP BY l_returnflag""")
def q_unexpected_classes(spark, sf):
    # training classes: order status; scoring labels: line return flags (a shared label space 'F').
    o = t(spark, sf, "orders").select(F.col("o_orderstatus").alias("y"))
    li = t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("y"))
    return C.unexpected_classes(o, li, "y")


# ------------------------------------------------------------------ F19 detection

def _detect_numeric_sql(table, col, n_unique_expr):
    return f"""(WITH s AS (SELECT count(*) AS n, count(DISTINCT {col}) + max(CASE WHEN {col} IS NULL THEN 1 ELSE 0 END) AS nu,
   max(CASE WHEN {col} IS NULL THEN 1 ELSE 0 END) AS has_null, max({col}) - min({col}) AS rng FROM {table}),
 d AS (SELECT DISTINCT CAST({col} AS DOUBLE) AS v FROM {table} WHERE {col} IS NOT NULL),
 g AS (SELECT stddev_pop(gap) / avg(gap) AS ratio FROM (SELECT v - lag(v) OVER (ORDER BY v) AS gap FROM d) WHERE gap IS NOT NULL),
 pts AS (SELECT n, nu, nu * 1.0 / n AS ur, rng,
   (CASE WHEN nu > 1 AND has_null = 0 AND (SELECT ratio FROM g) < 0.1 THEN 1 ELSE 0 END) + (CASE WHEN nu * 1.0 / n < 0.01 THEN 1 ELSE 0 END) AS cp,
   (CASE WHEN nu * 1.0 / n > 0.3 THEN 1 ELSE 0 END) + (CASE WHEN rng > 100 AND nu * 1.0 / n > 0.1 THEN 1 ELSE 0 END) AS rp FROM s)
 SELECT CASE WHEN nu = 2 THEN 'classification' WHEN cp > rp AND nu <= 20 THEN 'classification' ELSE 'regression' END FROM pts)"""


@query("detect_problem_type", f"""
SELECT 'orders' AS table_name, 'o_totalprice' AS target, {_detect_numeric_sql('orders', 'o_totalprice', None)} AS problem_type
UNION ALL SELECT 'orders', 'o_orderstatus', 'classification'
UNION ALL SELECT 'labels', 'quality', {_detect_numeric_sql('labels', 'quality', None)}
UNION ALL SELECT 'part', 'p_size', {_detect_numeric_sql('part', 'p_size', None)}
UNION ALL SELECT 'lineitem', 'l_quantity', {_detect_numeric_sql('lineitem', 'l_quantity', None)}
UNION ALL SELECT 'events', 'value',
  CASE WHEN (SELECT count(*) FROM events) >= 10 AND (
     (SELECT count(*) FROM (SELECT ts < lag(ts) OVER (ORDER BY event_id) AS dn FROM events) WHERE dn) = 0 OR
     (SELECT count(*) FROM (SELECT ts > lag(ts) OVER (ORDER BY event_id) AS up FROM events) WHERE up) = 0)
  THEN 'time_series' ELSE {_detect_numeric_sql('events', 'value', None)} END
UNION ALL SELECT 'embeddings', '', 'clustering'""")
def q_detect(spark, sf):
    cases = [("orders", "o_totalprice", None), ("orders", "o_orderstatus", None), ("labels", "quality", None),
             ("part", "p_size", None), ("lineitem", "l_quantity", None), ("events", "value", "event_id"),
             ("embeddings", None, None)]
    out = None
    for table, target, seq in cases:
        d = DT.detection_table(t(spark, sf, table), target, seq, table)
        out = d if out is None else out.unionByName(d)
    return out


# ------------------------------------------------------------------ F1-F5 cleaning

@query("impute_mean", f"""
SELECT event_id, round(coalesce(value, avg(value) OVER ()), 6) AS value FROM {EVENTS_GAPS_SQL}""")
def q_impute_mean(spark, sf):
    g = events_gaps(spark, sf).select("event_id", "value")
    return rnd(R.impute(g, ["value"], "mean"))


@query("impute_median", f"""
SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {EVENTS_GAPS_SQL})), 6) AS value
FROM {EVENTS_GAPS_SQL}""")
def q_impute_median(spark, sf):
    g = events_gaps(spark, sf).select("event_id", "value")
    return rnd(R.impute(g, ["value"], "median"))


@query("impute_mode", f"""
WITH g AS {EVENTS_GAPS_SQL},
mv AS (SELECT min(v) AS m FROM (SELECT value AS v, count(*) AS n, max(count(*)) OVER () AS mx FROM g WHERE value IS NOT NULL GROUP BY value) WHERE n = mx),
mp AS (SELECT min(v) AS m FROM (SELECT props AS v, count(*) AS n, max(count(*)) OVER () AS mx FROM g WHERE props IS NOT NULL GROUP BY props) WHERE n = mx)
SELECT event_id, round(coalesce(value, (SELECT m FROM mv)), 6) AS value, coalesce(props, (SELECT m FROM mp)) AS props FROM g""")
def q_impute_mode(spark, sf):
    g = events_gaps(spark, sf).select("event_id", "value", "props")
    return rnd(R.impute(g, ["value", "props"], "most_frequent"))


def _bounds_sql(kind):
    parts = []
    for c in LI_NUM:
        if kind == "iqr":
            parts.append(f"SELECT '{c}' AS column_name, round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper "
                         f"FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)")
        else:
            parts.append(f"SELECT '{c}' AS column_name, round(m - 3.0 * s, 4) AS lower, round(m + 3.0 * s, 4) AS upper "
                         f"FROM (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem)")
    return "\nUNION ALL\n".join(parts)


def _bounds_df(spark, bounds, digits=6):
    rows = [(c, float(lo), float(hi)) for c, (lo, hi) in bounds.items()]
    return rnd(spark.createDataFrame(rows, "column_name string, lower double, upper double"), digits)


@query("iqr_bounds", _bounds_sql("iqr"))
def q_iqr_bounds(spark, sf):
    return _bounds_df(spark, R.outlier_bounds(t(spark, sf, "lineitem"), LI_NUM, "iqr", 1.5))


@query("zscore_bounds", _bounds_sql("z"))
def q_zscore_bounds(spark, sf):
    return _bounds_df(spark, R.outlier_bounds(t(spark, sf, "lineitem"), LI_NUM, "zscore", 3.0), 4)


CLIP_SQL_BOUNDS = """(SELECT quantile_cont(o_totalprice, 0.25) - 1.0 * (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) AS lo,
        quantile_cont(o_totalprice, 0.75) + 1.0 * (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) AS hi FROM orders)"""


@query("clip_outliers", f"""
SELECT o_orderkey, round(CASE WHEN o_totalprice IS NULL THEN NULL WHEN o_totalprice < lo THEN lo WHEN o_totalprice > hi THEN hi
  ELSE o_totalprice END, 6) AS o_totalprice FROM orders, {CLIP_SQL_BOUNDS} b""")
def q_clip(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    b = R.outlier_bounds(o, ["o_totalprice"], "iqr", 1.0)
    return rnd(R.apply_outliers(o, b, "clip"))


@query("remove_outliers", f"""
WITH b1 AS {CLIP_SQL_BOUNDS},
b2 AS (SELECT quantile_cont(o_custkey, 0.25) - 1.0 * (quantile_cont(o_custkey, 0.75) - quantile_cont(o_custkey, 0.25)) AS lo,
              quantile_cont(o_custkey, 0.75) + 1.0 * (quantile_cont(o_custkey, 0.75) - quantile_cont(o_custkey, 0.25)) AS hi FROM orders)
SELECT o_orderkey, o_custkey, o_totalprice FROM orders, b1, b2
WHERE o_totalprice BETWEEN b1.lo AND b1.hi AND o_custkey BETWEEN b2.lo AND b2.hi""")
def q_remove(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    b = R.outlier_bounds(o, ["o_totalprice", "o_custkey"], "iqr", 1.0)
    return R.apply_outliers(o, b, "remove")


@query("outlier_counts", f"""
WITH b1 AS {CLIP_SQL_BOUNDS},
b2 AS (SELECT quantile_cont(o_custkey, 0.25) - 1.0 * (quantile_cont(o_custkey, 0.75) - quantile_cont(o_custkey, 0.25)) AS lo,
              quantile_cont(o_custkey, 0.75) + 1.0 * (quantile_cont(o_custkey, 0.75) - quantile_cont(o_custkey, 0.25)) AS hi FROM orders)
SELECT 'o_totalprice' AS column_name, round(b1.lo, 6) AS lower, round(b1.hi, 6) AS upper,
  CAST(sum(CASE WHEN o_totalprice < b1.lo OR o_totalprice > b1.hi THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers FROM orders, b1 GROUP BY 1, 2, 3
UNION ALL
SELECT 'o_custkey', round(b2.lo, 6), round(b2.hi, 6),
  CAST(sum(CASE WHEN (o_custkey < b2.lo OR o_custkey > b2.hi) AND o_totalprice BETWEEN b1.lo AND b1.hi THEN 1 ELSE 0 END) AS BIGINT)
FROM orders, b1, b2 GROUP BY 1, 2, 3""")
def q_outlier_counts(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    b = R.outlier_bounds(o, ["o_totalprice", "o_custkey"], "iqr", 1.0)
    return rnd(R.outlier_counts(o, b, "remove"))


# ------------------------------------------------------------------ F6-F11, F16 encoding & scaling

@query("scale_standard", """
SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / coalesce(nullif(stddev_pop(p_size) OVER (), 0), 1), 6) AS p_size,
  round((p_retailprice - avg(p_retailprice) OVER ()) / coalesce(nullif(stddev_pop(p_retailprice) OVER (), 0), 1), 6) AS p_retailprice
FROM part""")
def q_scale_standard(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return rnd(R.scale(p, ["p_size", "p_retailprice"], "standard"))


@query("scale_minmax", """
SELECT p_partkey, round((p_size - min(p_size) OVER ()) / coalesce(nullif(max(p_size) OVER () - min(p_size) OVER (), 0), 1), 6) AS p_size,
  round((p_retailprice - min(p_retailprice) OVER ()) / coalesce(nullif(max(p_retailprice) OVER () - min(p_retailprice) OVER (), 0), 1), 6) AS p_retailprice
FROM part""")
def q_scale_minmax(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return rnd(R.scale(p, ["p_size", "p_retailprice"], "minmax"))


@query("scale_robust", """
WITH q AS (SELECT quantile_cont(p_size, 0.5) AS ms, quantile_cont(p_size, 0.75) - quantile_cont(p_size, 0.25) AS is_,
  quantile_cont(p_retailprice, 0.5) AS mr, quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25) AS ir FROM part)
SELECT p_partkey, round((p_size - ms) / coalesce(nullif(is_, 0), 1), 6) AS p_size,
  round((p_retailprice - mr) / coalesce(nullif(ir, 0), 1), 6) AS p_retailprice FROM part, q""")
def q_scale_robust(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return rnd(R.scale(p, ["p_size", "p_retailprice"], "robust"))


@query("one_hot", """
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_mktsegment_index,
  CAST(count(DISTINCT c_mktsegment) OVER () AS INTEGER) AS c_mktsegment_size FROM customer""")
def q_one_hot(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return R.one_hot_index(c, "c_mktsegment").drop("c_mktsegment")


@query("label_encode", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus_encoded FROM orders""")
def q_label_encode(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return R.label_encode(o, "o_orderstatus").drop("o_orderstatus")


@query("class_weights", """
SELECT quality AS cls, count(*) AS n_class,
  round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS class_weight FROM labels WHERE quality IS NOT NULL GROUP BY quality""")
def q_class_weights(spark, sf):
    return rnd(R.class_weights(t(spark, sf, "labels"), "quality"))


# ------------------------------------------------------------------ F12-F14 splits, A14/A15 drift

@query("split_random", f"""
SELECT o_orderkey, CASE WHEN {HASH_UNIT_SQL.format(id='o_orderkey')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM orders""")
def q_split_random(spark, sf):
    return R.split_random(t(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


@query("split_stratified", f"""
SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY {HASH_FRAC_SQL.format(id='o_orderkey')}, o_orderkey)
  <= ceil(0.2 * count(*) OVER (PARTITION BY o_orderstatus)) THEN 'test' ELSE 'train' END AS split FROM orders""")
def q_split_stratified(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return R.split_stratified(o, "o_orderstatus", ["o_orderkey"]).drop("o_orderstatus")


@query("split_chrono", """
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor(0.8 * count(*) OVER ())
  THEN 'train' ELSE 'test' END AS split FROM orders""")
def q_split_chrono(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return R.split_chronological(o, "o_orderdate", "o_orderkey").drop("o_orderdate")


ORDERS_SPLIT_SQL = f"(SELECT *, CASE WHEN {HASH_UNIT_SQL.format(id='o_orderkey')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM orders)"


@query("drift_mean", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, round(tr, 4) AS train_mean, round(te, 4) AS test_mean,
  round(CASE WHEN tr <> 0 THEN abs(tr - te) / abs(tr) * 100 END, 6) AS drift_pct,
  coalesce(CASE WHEN tr <> 0 THEN abs(tr - te) / abs(tr) * 100 END > 10, FALSE) AS warn
FROM (SELECT avg(CASE WHEN split = 'train' THEN CAST({c} AS DOUBLE) END) AS tr, avg(CASE WHEN split = 'test' THEN CAST({c} AS DOUBLE) END) AS te
      FROM {ORDERS_SPLIT_SQL})""" for c in ["o_custkey", "o_totalprice"]))
def q_drift_mean(spark, sf):
    o = R.split_random(t(spark, sf, "orders"), ["o_orderkey"])
    return rnd(M.mean_drift(o, ["o_custkey", "o_totalprice"]), train_mean=4, test_mean=4)


@query("drift_class", f"""
WITH c AS (SELECT o_orderstatus AS cls, sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS ntr,
  sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS nte FROM {ORDERS_SPLIT_SQL} WHERE o_orderstatus IS NOT NULL GROUP BY 1)
SELECT cls, round(ntr * 100.0 / sum(ntr) OVER (), 6) AS train_pct, round(nte * 100.0 / sum(nte) OVER (), 6) AS test_pct,
  round(abs(ntr * 100.0 / sum(ntr) OVER () - nte * 100.0 / sum(nte) OVER ()), 6) AS diff_pct FROM c""")
def q_drift_class(spark, sf):
    o = R.split_random(t(spark, sf, "orders"), ["o_orderkey"])
    return rnd(M.class_share_drift(o, "o_orderstatus"))


# ------------------------------------------------------------------ X1-X5, F17 datetime features

@query("datetime_features", """
SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS o_orderdate_year, CAST(month(o_orderdate) AS BIGINT) AS o_orderdate_month,
  CAST(day(o_orderdate) AS BIGINT) AS o_orderdate_day, CAST(isodow(o_orderdate) - 1 AS BIGINT) AS o_orderdate_dayofweek,
  CAST(dayofyear(o_orderdate) AS BIGINT) AS o_orderdate_dayofyear, CAST(quarter(o_orderdate) AS BIGINT) AS o_orderdate_quarter,
  isodow(o_orderdate) >= 6 AS o_orderdate_is_weekend, CAST(o_orderdate AS DATE) = last_day(o_orderdate) AS o_orderdate_is_month_end,
  round(sin(2 * pi() * month(o_orderdate) / 12), 6) AS o_orderdate_month_sin, round(cos(2 * pi() * month(o_orderdate) / 12), 6) AS o_orderdate_month_cos,
  round(sin(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) AS o_orderdate_dayofweek_sin, round(cos(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) AS o_orderdate_dayofweek_cos,
  CAST(floor(epoch_us(o_orderdate - TIMESTAMP '2000-01-01 00:00:00') / 86400000000) AS BIGINT) AS o_orderdate_days_from_y2k,
  CAST(floor(epoch_us(o_orderdate) / 86400000000) AS BIGINT) AS o_orderdate_days_from_epoch
FROM orders""")
def q_datetime_features(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return rnd(TF.datetime_features(o, ["o_orderdate"], ref_dates={"y2k": "2000-01-01 00:00:00"}, drop_source=True))


@query("datetime_features_time", """
SELECT event_id, CAST(year(ts) AS BIGINT) AS ts_year, CAST(month(ts) AS BIGINT) AS ts_month, CAST(day(ts) AS BIGINT) AS ts_day,
  CAST(isodow(ts) - 1 AS BIGINT) AS ts_dayofweek, CAST(dayofyear(ts) AS BIGINT) AS ts_dayofyear, CAST(quarter(ts) AS BIGINT) AS ts_quarter,
  CAST(hour(ts) AS BIGINT) AS ts_hour, CAST(minute(ts) AS BIGINT) AS ts_minute,
  isodow(ts) >= 6 AS ts_is_weekend, CAST(ts AS DATE) = last_day(ts) AS ts_is_month_end,
  round(sin(2 * pi() * month(ts) / 12), 6) AS ts_month_sin, round(cos(2 * pi() * month(ts) / 12), 6) AS ts_month_cos,
  round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) AS ts_dayofweek_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) AS ts_dayofweek_cos,
  round(sin(2 * pi() * hour(ts) / 24), 6) AS ts_hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS ts_hour_cos,
  CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS ts_days_from_epoch
FROM events""")
def q_datetime_features_time(spark, sf):
    e = t(spark, sf, "events").select("event_id", "ts")
    return rnd(TF.datetime_features(e, ["ts"], drop_source=True))


# ------------------------------------------------------------------ W1-W9 series operators

def _lag_sql(cols_sql):
    return f"SELECT event_id, {cols_sql} FROM events"


W_USER = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query("ts_lag", _lag_sql(", ".join(f"lag(value, {k}) {W_USER} AS value_lag_{k}" for k in (1, 7, 14, 30))))
def q_ts_lag(spark, sf):
    e = t(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    return S.series_features(e, ["value"], ["ts", "event_id"], ["user_id"], lags=(1, 7, 14, 30), windows=(),
                             diffs=()).select("event_id", "value_lag_1", "value_lag_7", "value_lag_14", "value_lag_30")


def _roll_sql():
    cols = []
    for w in (7, 14, 30):
        fr = f"OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        for f, agg in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            cols.append(f"round(CASE WHEN count(value) {fr} = {w} THEN {agg}(value) {fr} END, 6) AS value_rolling_{w}_{f}")
    return "SELECT event_id, " + ", ".join(cols) + " FROM events"


@query("ts_rolling", _roll_sql())
def q_ts_rolling(spark, sf):
    e = t(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    return rnd(S.series_features(e, ["value"], ["ts", "event_id"], ["user_id"], lags=(), diffs=()).drop(
        "ts", "user_id", "value"))


@query("ts_diff", _lag_sql(", ".join(f"round(value - lag(value, {k}) {W_USER}, 6) AS value_diff_{k}" for k in (1, 7))))
def q_ts_diff(spark, sf):
    e = t(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    return rnd(S.series_features(e, ["value"], ["ts", "event_id"], ["user_id"], lags=(), windows=(), diffs=(1, 7))
               .select("event_id", "value_diff_1", "value_diff_7"))


@query("ts_rolling_extra", "SELECT event_id, " + ", ".join(
    f"round(CASE WHEN count(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 "
    f"THEN {agg}(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END, 6) AS value_rolling_5_{f}"
    for f, agg in (("sum", "sum"), ("var", "var_samp"), ("median", "median"))) + " FROM events")
def q_ts_rolling_extra(spark, sf):
    e = t(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    return rnd(S.series_features(e, ["value"], ["ts", "event_id"], ["user_id"], lags=(), windows=(5,),
                                 funcs=("sum", "var", "median"), diffs=()).drop("ts", "user_id", "value"))


@query("ffill", f"""
WITH g AS {EVENTS_GAPS_SQL}
SELECT event_id, round(coalesce(
  last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  avg(value) OVER ()), 6) AS value FROM g""")
def q_ffill(spark, sf):
    g = events_gaps(spark, sf).select("event_id", "ts", "user_id", "value")
    return rnd(S.fill_series(g, ["value"], ["ts", "event_id"], ["user_id"]).select("event_id", "value"))


@query("monotonic", """
SELECT 'events.ts by event_id' AS series,
  count(*) FILTER (WHERE d < 0) = 0 AS increasing, count(*) FILTER (WHERE d > 0) = 0 AS decreasing
FROM (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY event_id) AS d FROM events)
UNION ALL
SELECT 'orders.o_orderdate by o_orderkey', count(*) FILTER (WHERE d < 0) = 0, count(*) FILTER (WHERE d > 0) = 0
FROM (SELECT epoch_us(o_orderdate) - lag(epoch_us(o_orderdate)) OVER (ORDER BY o_orderkey) AS d FROM orders)""")
def q_monotonic(spark, sf):
    a = S.monotonic_check(t(spark, sf, "events"), "ts", "event_id")
    b = S.monotonic_check(t(spark, sf, "orders"), "o_orderdate", "o_orderkey")
    return spark.createDataFrame([("events.ts by event_id", a["increasing"], a["decreasing"]),
                                  ("orders.o_orderdate by o_orderkey", b["increasing"], b["decreasing"])],
                                 "series string, increasing boolean, decreasing boolean")


@query("duplicate_ts", "SELECT count(*) - count(DISTINCT o_orderdate) AS n_duplicates FROM orders")
def q_duplicate_ts(spark, sf):
    return S.duplicate_count(t(spark, sf, "orders"), "o_orderdate")


@query("future_dates", """
SELECT user_id, step, last_ts + step * INTERVAL 1 DAY AS ts
FROM (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id), range(1, 8) r(step)""")
def q_future_dates(spark, sf):
    return S.future_dates(t(spark, sf, "events"), "ts", ["user_id"], "D", 7) \
            .select("user_id", F.col("step").cast("long").alias("step"), F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("cumsum", """
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS value_cumsum
FROM events""")
def q_cumsum(spark, sf):
    e = t(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    return rnd(S.cumulative_sum(e, "value", ["ts", "event_id"], ["user_id"]).select("event_id", "value_cumsum"), 4)


@query("tail_rows", """
SELECT event_id, user_id FROM (SELECT event_id, user_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 30""")
def q_tail_rows(spark, sf):
    e = t(spark, sf, "events").select("event_id", "ts", "user_id")
    return S.tail_rows(e, 30, ["ts", "event_id"], ["user_id"]).select("event_id", "user_id")


# ------------------------------------------------------------------ E1-E3, A18-A20, A23 regression metrics

LI_PRED = "l_quantity * 1000.0 + 1500.0"


def li_pred(spark, sf):
    return t(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("actual"),
                                          (F.col("l_quantity") * 1000.0 + 1500.0).alias("prediction"))


@query("reg_metrics", f"""
SELECT count(*) AS n, round(avg(e * e), 2) AS mse, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae,
  round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(e) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape
FROM (SELECT l_extendedprice AS y, l_extendedprice - ({LI_PRED}) AS e FROM lineitem)""")
def q_reg_metrics(spark, sf):
    return rnd(M.regression_metrics(li_pred(spark, sf), "actual", "prediction"), mse=2)


@query("error_stats", f"""
SELECT round(avg(e), 6) AS mean_error, round(median(e), 6) AS median_error, round(stddev_pop(e), 6) AS std_error,
  round(avg(abs(e)), 6) AS mean_abs_error, round(median(abs(e)), 6) AS median_abs_error, round(min(e), 6) AS min_error,
  round(max(e), 6) AS max_error, round(quantile_cont(e, 0.25), 6) AS q1_error, round(quantile_cont(e, 0.75), 6) AS q3_error
FROM (SELECT l_extendedprice - ({LI_PRED}) AS e FROM lineitem)""")
def q_error_stats(spark, sf):
    return rnd(M.error_stats(li_pred(spark, sf), "actual", "prediction"))


@query("residual_percentiles", "\nUNION ALL\n".join(
    f"SELECT {int(p * 100)} AS percentile, round(quantile_cont(e, {p}), 6) AS residual, round(quantile_cont(abs(e), {p}), 6) AS abs_residual "
    f"FROM (SELECT l_extendedprice - ({LI_PRED}) AS e FROM lineitem)" for p in M.RESIDUAL_PROBS))
def q_residual_percentiles(spark, sf):
    return rnd(M.residual_percentiles(li_pred(spark, sf), "actual", "prediction"))


@query("extreme_errors", f"""
WITH r AS (SELECT l_extendedprice - ({LI_PRED}) AS e FROM lineitem),
s AS (SELECT stddev_pop(e) AS sd, quantile_cont(abs(e), 0.95) AS p95 FROM r)
SELECT count(*) AS n, CAST(sum(CASE WHEN abs(e) > 3 * sd THEN 1 ELSE 0 END) AS BIGINT) AS n_extreme,
  round(sum(CASE WHEN abs(e) > 3 * sd THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS extreme_pct,
  CAST(sum(CASE WHEN abs(e) > p95 THEN 1 ELSE 0 END) AS BIGINT) AS n_large,
  round(sum(CASE WHEN abs(e) > p95 THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS large_pct, round(p95, 6) AS p95_abs_error
FROM r, s GROUP BY sd, p95""")
def q_extreme_errors(spark, sf):
    return rnd(M.extreme_errors(li_pred(spark, sf), "actual", "prediction"))


@query("prediction_stats", f"""
SELECT round(min(p), 6) AS pred_min, round(max(p), 6) AS pred_max, round(avg(p), 6) AS pred_mean, round(stddev_pop(p), 6) AS pred_std
FROM (SELECT {LI_PRED} AS p FROM lineitem)""")
def q_prediction_stats(spark, sf):
    return rnd(M.prediction_stats(li_pred(spark, sf), "prediction"))


# ------------------------------------------------------------------ E4-E8, A16, A22, A24, A25 classification metrics

ORD_PRED_SQL = """(SELECT o_orderkey, o_orderstatus AS actual,
  CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 300000 THEN 'O' ELSE 'P' END AS predicted,
  least(0.99, 0.34 + abs(o_totalprice - 225000) / 1000000.0) AS confidence FROM orders)"""


def ord_pred(spark, sf):
    o = t(spark, sf, "orders")
    pred = (F.when(F.col("o_totalprice") < 150000, "F").when(F.col("o_totalprice") < 300000, "O").otherwise("P"))
    conf = F.least(F.lit(0.99), F.lit(0.34) + F.abs(F.col("o_totalprice") - 225000) / 1000000.0)
    return o.select("o_orderkey", F.col("o_orderstatus").alias("actual"), pred.alias("predicted"), conf.alias("confidence"))


CLASS_REPORT_SQL = f"""WITH cm AS (SELECT actual, predicted, count(*) AS n FROM {ORD_PRED_SQL} GROUP BY 1, 2),
lab AS (SELECT actual AS label FROM cm UNION SELECT predicted FROM cm),
r AS (SELECT label,
  coalesce((SELECT sum(n) FROM cm WHERE actual = label), 0) AS support,
  coalesce((SELECT sum(n) FROM cm WHERE predicted = label), 0) AS npred,
  coalesce((SELECT sum(n) FROM cm WHERE actual = label AND predicted = label), 0) AS tp FROM lab),
p AS (SELECT label, CASE WHEN npred > 0 THEN tp * 1.0 / npred ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN tp * 1.0 / support ELSE 0.0 END AS recall, support, npred, tp FROM r),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM p)"""


@query("class_report", CLASS_REPORT_SQL + """
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, CAST(support AS BIGINT) AS support,
  CAST(npred AS BIGINT) AS n_predicted, CAST(tp AS BIGINT) AS tp, round(f1, 6) AS f1 FROM f""")
def q_class_report(spark, sf):
    return rnd(M.class_report(ord_pred(spark, sf), "actual", "predicted"))


@query("cls_metrics", CLASS_REPORT_SQL + """
SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(tp) * 1.0 / sum(support), 6) AS accuracy,
  round(avg(CASE WHEN support > 0 THEN recall END), 6) AS balanced_accuracy,
  round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro,
  round(sum(precision * support) / sum(support), 6) AS precision_weighted, round(sum(recall * support) / sum(support), 6) AS recall_weighted,
  round(sum(f1 * support) / sum(support), 6) AS f1_weighted,
  round(sum(tp) * 1.0 / sum(support), 6) AS precision_micro, round(sum(tp) * 1.0 / sum(support), 6) AS recall_micro,
  round(sum(tp) * 1.0 / sum(support), 6) AS f1_micro,
  CASE WHEN count(*) = 2 THEN round(max_by(precision, label), 6) END AS precision_binary,
  CASE WHEN count(*) = 2 THEN round(max_by(recall, label), 6) END AS recall_binary,
  CASE WHEN count(*) = 2 THEN round(max_by(f1, label), 6) END AS f1_binary FROM f""")
def q_cls_metrics(spark, sf):
    return rnd(M.classification_metrics(ord_pred(spark, sf), "actual", "predicted"))


@query("confusion", f"SELECT actual, predicted, count(*) AS count FROM {ORD_PRED_SQL} GROUP BY 1, 2")
def q_confusion(spark, sf):
    return M.confusion(ord_pred(spark, sf), "actual", "predicted")


LAB_SCORE_SQL = """(SELECT l.doc_id, l.quality AS actual,
  1.0 / (1.0 + exp(-(ln(d.n_chars + 1) - 7.0))) AS score,
  CASE WHEN 1.0 / (1.0 + exp(-(ln(d.n_chars + 1) - 7.0))) >= 0.5 THEN 1 ELSE 0 END AS predicted
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def lab_score(spark, sf):
    lab = t(spark, sf, "labels")
    docs = t(spark, sf, "documents").select("doc_id", "n_chars")
    score = 1.0 / (1.0 + F.exp(-(F.ln(F.col("n_chars") + 1) - 7.0)))
    j = lab.join(docs, "doc_id")
    return j.select("doc_id", F.col("quality").alias("actual"), score.alias("score"),
                    F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))


@query("binary_counts", f"""
WITH s AS {LAB_SCORE_SQL},
pos AS (SELECT max(l) AS pos FROM (SELECT CAST(actual AS VARCHAR) AS l FROM s UNION SELECT CAST(predicted AS VARCHAR) FROM s)),
c AS (SELECT max(pos) AS positive_label,
  CAST(sum(CASE WHEN CAST(actual AS VARCHAR) = pos AND CAST(predicted AS VARCHAR) = pos THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN CAST(actual AS VARCHAR) <> pos AND CAST(predicted AS VARCHAR) = pos THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN CAST(actual AS VARCHAR) = pos AND CAST(predicted AS VARCHAR) <> pos THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN CAST(actual AS VARCHAR) <> pos AND CAST(predicted AS VARCHAR) <> pos THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM s, pos)
SELECT *, round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN
  (tp * tn - fp * fn) / sqrt(CAST((tp + fp) AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0.0 END, 6) AS mcc FROM c""")
def q_binary_counts(spark, sf):
    return rnd(M.binary_counts(lab_score(spark, sf), "actual", "predicted"))


@query("ranking_metrics", f"""
WITH s AS {LAB_SCORE_SQL},
sc AS (SELECT score AS v, sum(CASE WHEN actual = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN actual = 1 THEN 0 ELSE 1 END) AS neg FROM s GROUP BY score),
cum AS (SELECT v, pos, neg,
  coalesce(sum(neg) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
  sum(pos) OVER (ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
  sum(neg) OVER (ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM sc)
SELECT '1' AS positive_label, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
  round(sum(pos * (neg_below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS roc_auc,
  round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision FROM cum""")
def q_ranking_metrics(spark, sf):
    return rnd(M.ranking_metrics(lab_score(spark, sf), "actual", "score", positive=1))


@query("log_loss", f"""
SELECT round(avg(-ln(least(greatest(CASE WHEN actual = 1 THEN score ELSE 1 - score END, 1e-15), 1 - 1e-15))), 6) AS log_loss
FROM {LAB_SCORE_SQL}""")
def q_log_loss(spark, sf):
    s = lab_score(spark, sf).withColumn("p_true", F.when(F.col("actual") == 1, F.col("score")).otherwise(1 - F.col("score")))
    return rnd(M.log_loss(s, "p_true"))


@query("outcome_summary", f"""
SELECT CAST(sum(CASE WHEN actual = predicted THEN 1 ELSE 0 END) AS BIGINT) AS correct,
  CAST(sum(CASE WHEN actual = predicted THEN 0 ELSE 1 END) AS BIGINT) AS incorrect, count(*) AS total,
  round(sum(CASE WHEN actual = predicted THEN 1 ELSE 0 END) * 1.0 / count(*), 6) AS accuracy FROM {ORD_PRED_SQL}""")
def q_outcome_summary(spark, sf):
    return rnd(M.outcome_summary(ord_pred(spark, sf), "actual", "predicted"))


@query("misclassified_groups", f"""
WITH w AS (SELECT actual AS a, predicted AS p FROM {ORD_PRED_SQL} WHERE actual <> predicted)
SELECT 'actual' AS grouping, a AS actual, CAST(NULL AS VARCHAR) AS predicted, count(*) AS count FROM w GROUP BY a
UNION ALL SELECT 'predicted', NULL, p, count(*) FROM w GROUP BY p
UNION ALL SELECT 'pair', a, p, count(*) FROM w GROUP BY a, p""")
def q_misclassified_groups(spark, sf):
    return M.misclassified_groups(ord_pred(spark, sf), "actual", "predicted")


@query("never_predicted", f"""
SELECT DISTINCT CAST(l_linestatus AS VARCHAR) AS label FROM lineitem
WHERE CAST(l_linestatus AS VARCHAR) NOT IN (SELECT DISTINCT CASE WHEN l_discount >= 0.05 THEN 'O' ELSE 'O' END FROM lineitem)""")
def q_never_predicted(spark, sf):
    li = t(spark, sf, "lineitem").select(F.col("l_linestatus").alias("actual"),
                                        F.when(F.col("l_discount") >= 0.05, "O").otherwise("O").alias("predicted"))
    return M.never_predicted(li, "actual", "predicted")


@query("confidence_profile", f"""
SELECT round(avg(confidence), 6) AS mean_confidence, CAST(sum(CASE WHEN confidence < 0.7 THEN 1 ELSE 0 END) AS BIGINT) AS n_low_confidence,
  round(avg(CASE WHEN actual = predicted THEN confidence END), 6) AS mean_confidence_correct,
  round(avg(CASE WHEN actual <> predicted THEN confidence END), 6) AS mean_confidence_incorrect FROM {ORD_PRED_SQL}""")
def q_confidence_profile(spark, sf):
    return rnd(M.confidence_profile(ord_pred(spark, sf), "actual", "predicted", "confidence"))


# ------------------------------------------------------------------ E9-E12, A17 clustering scores

EMB_LONG_SQL = "(SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS j FROM embeddings)"


@query("cluster_sizes", "SELECT label AS cluster, count(*) AS size FROM embeddings GROUP BY label")
def q_cluster_sizes(spark, sf):
    return M.cluster_sizes(t(spark, sf, "embeddings"), "label")


@query("cluster_scores", f"""
WITH l AS {EMB_LONG_SQL},
cen AS (SELECT label AS cl, j, avg(x) AS mu FROM l GROUP BY 1, 2),
cn AS (SELECT label AS cl, count(*) AS n FROM embeddings GROUP BY 1),
tot AS (SELECT j, avg(x) AS m FROM l GROUP BY j),
k AS (SELECT count(*) AS k, sum(n) AS n FROM cn),
bw AS (SELECT sum(cn.n * (cen.mu - tot.m) * (cen.mu - tot.m)) AS b FROM cen JOIN cn USING (cl) JOIN tot USING (j)),
wi AS (SELECT sum((l.x - cen.mu) * (l.x - cen.mu)) AS w FROM l JOIN cen ON l.label = cen.cl AND l.j = cen.j),
pd AS (SELECT l.vec_id, l.label AS cl, sqrt(sum((l.x - cen.mu) * (l.x - cen.mu))) AS d FROM l JOIN cen ON l.label = cen.cl AND l.j = cen.j GROUP BY 1, 2),
sp AS (SELECT cl, avg(d) AS s FROM pd GROUP BY cl),
cd AS (SELECT a.cl AS ci, b.cl AS cj, sqrt(sum((a.mu - b.mu) * (a.mu - b.mu))) AS dij FROM cen a JOIN cen b ON a.j = b.j AND a.cl <> b.cl GROUP BY 1, 2),
db AS (SELECT avg(worst) AS db FROM (SELECT ci, max((si.s + sj.s) / dij) AS worst FROM cd JOIN sp si ON si.cl = ci JOIN sp sj ON sj.cl = cj GROUP BY ci)),
xx AS (SELECT vec_id, label, sum(x * x) AS xx FROM l GROUP BY 1, 2),
ss AS (SELECT label AS cl, sum(xx) AS ss FROM xx GROUP BY 1),
dot AS (SELECT l.vec_id, cen.cl, sum(l.x * cen.mu) AS dot FROM l JOIN cen ON l.j = cen.j GROUP BY 1, 2),
dist AS (SELECT xx.vec_id, xx.label AS own, dot.cl, xx.xx - 2 * dot.dot + ss.ss / cn.n AS d, cn.n AS nc
         FROM xx JOIN dot USING (vec_id) JOIN ss ON ss.cl = dot.cl JOIN cn ON cn.cl = dot.cl),
sil AS (SELECT vec_id, max(CASE WHEN cl = own THEN d * nc / greatest(nc - 1, 1) END) AS a, min(CASE WHEN cl <> own THEN d END) AS b,
        max(CASE WHEN cl = own THEN nc END) AS own_n FROM dist GROUP BY vec_id)
SELECT CAST(k.k AS INTEGER) AS n_clusters, CAST(k.n AS BIGINT) AS n, round((bw.b / (k.k - 1)) / (wi.w / (k.n - k.k)), 4) AS calinski_harabasz,
  round(db.db, 6) AS davies_bouldin, round(wi.w, 4) AS inertia,
  round((SELECT avg(CASE WHEN own_n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END) FROM sil), 6) AS silhouette_sq
FROM k, bw, wi, db""")
def q_cluster_scores(spark, sf):
    e = t(spark, sf, "embeddings")
    return rnd(M.clustering_scores(e, "embedding", "label"), calinski_harabasz=4, inertia=4)


# ------------------------------------------------------------------ M1 (one feature) and M13 closed forms

@query("linreg_1d", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
  round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem""")
def q_linreg_1d(spark, sf):
    from tabforge.operators.models import linear_1d
    return rnd(linear_1d(t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"), intercept=4)


@query("gaussian_nb", """
WITH tr AS (SELECT p_partkey, p_type AS y, CAST(p_size AS DOUBLE) AS x1, p_retailprice AS x2 FROM part),
eps AS (SELECT 1e-9 * greatest(var_pop(x1), var_pop(x2)) AS e FROM tr),
st AS (SELECT y, count(*) AS n, avg(x1) AS m1, var_pop(x1) + (SELECT e FROM eps) AS v1, avg(x2) AS m2,
  var_pop(x2) + (SELECT e FROM eps) AS v2 FROM tr GROUP BY y),
ll AS (SELECT tr.p_partkey, st.y, ln(st.n * 1.0 / (SELECT count(*) FROM tr))
   - 0.5 * ln(2 * pi() * st.v1) - (tr.x1 - st.m1) * (tr.x1 - st.m1) / (2 * st.v1)
   - 0.5 * ln(2 * pi() * st.v2) - (tr.x2 - st.m2) * (tr.x2 - st.m2) / (2 * st.v2) AS s FROM tr, st)
SELECT p_partkey, min(y) FILTER (WHERE rk = 1) AS prediction FROM (
  SELECT p_partkey, y, rank() OVER (PARTITION BY p_partkey ORDER BY s DESC) AS rk FROM ll) GROUP BY p_partkey""")
def q_gaussian_nb(spark, sf):
    from tabforge.operators.models import GaussianNB
    p = t(spark, sf, "part").select("p_partkey", F.col("p_type").alias("y"), F.col("p_size").cast("double").alias("x1"),
                                    F.col("p_retailprice").alias("x2"))
    model = GaussianNB(["x1", "x2"], "y").fit(p)
    return model.transform(p).select("p_partkey", "prediction")


# ------------------------------------------------------------------ T5-T8 samples, S9-S11 versions

@query("sample_random", f"""
SELECT o_orderkey FROM orders ORDER BY {HASH_FRAC_SQL.format(id='o_orderkey')}, o_orderkey LIMIT 100""")
def q_sample_random(spark, sf):
    from tabforge.operators.sampling import sample_hash
    return sample_hash(t(spark, sf, "orders"), ["o_orderkey"], 100).select("o_orderkey")


@query("sample_error_biased", f"""
WITH s AS (SELECT o_orderkey, actual, predicted, actual <> predicted AS wrong, {HASH_FRAC_SQL.format(id='o_orderkey')} AS h FROM {ORD_PRED_SQL}),
k AS (SELECT count(DISTINCT actual) AS k FROM s WHERE wrong),
q AS (SELECT greatest(1, 50 // (SELECT k FROM k)) AS per),
w AS (SELECT *, row_number() OVER (PARTITION BY actual ORDER BY h, o_orderkey) AS r FROM s WHERE wrong),
first_pick AS (SELECT o_orderkey FROM w, q WHERE r <= per),
fill AS (SELECT o_orderkey FROM (SELECT o_orderkey FROM w WHERE o_orderkey NOT IN (SELECT o_orderkey FROM first_pick)
  ORDER BY h, o_orderkey LIMIT greatest(0, least(50, (SELECT count(*) FROM w)) - (SELECT count(*) FROM first_pick)))),
wrong_pick AS (SELECT o_orderkey FROM first_pick UNION ALL SELECT o_orderkey FROM fill),
right_pick AS (SELECT o_orderkey FROM s WHERE NOT wrong ORDER BY h, o_orderkey LIMIT (100 - (SELECT count(*) FROM wrong_pick)))
SELECT o_orderkey FROM wrong_pick UNION ALL SELECT o_orderkey FROM right_pick""")
def q_sample_error_biased(spark, sf):
    from tabforge.operators.sampling import sample_error_biased
    return sample_error_biased(ord_pred(spark, sf), "actual", "predicted", ["o_orderkey"], 100).select("o_orderkey")


@query("sample_high_residual", f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, abs(l_extendedprice - ({LI_PRED})) AS ae,
  {HASH_FRAC_SQL.replace("CAST({id} AS VARCHAR)", "CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR)")} AS h FROM lineitem),
p AS (SELECT quantile_cont(ae, 0.9) AS p90 FROM r),
hi AS (SELECT l_orderkey, l_linenumber, l_partkey, h FROM r, p WHERE ae > p90 ORDER BY h, l_orderkey, l_linenumber, l_partkey LIMIT 25),
lo AS (SELECT l_orderkey, l_linenumber, l_partkey, h FROM r, p WHERE NOT (ae > p90) ORDER BY h, l_orderkey, l_linenumber, l_partkey
  LIMIT (100 - (SELECT count(*) FROM hi)))
SELECT l_orderkey, l_linenumber, l_partkey FROM hi UNION ALL SELECT l_orderkey, l_linenumber, l_partkey FROM lo""")
def q_sample_high_residual(spark, sf):
    from tabforge.operators.sampling import sample_high_residual
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                        F.col("l_extendedprice").alias("actual"),
                                        (F.col("l_quantity") * 1000.0 + 1500.0).alias("prediction"))
    return sample_high_residual(li, "actual", "prediction", ["l_orderkey", "l_linenumber", "l_partkey"], 100) \
        .select("l_orderkey", "l_linenumber", "l_partkey")


RUNS_SQL = """(SELECT 'm' || CAST(user_id AS VARCHAR) AS model_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS version,
  event_type <> 'error' AS has_model FROM events)"""


def runs_table(spark, sf):
    """A version table derived from events: one model per user, one version per event,
    a model artifact unless the event is an error."""
    e = t(spark, sf, "events")
    ix = S.sequence_index(e, ["ts", "event_id"], ["user_id"], "_seq")
    return ix.select(F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model_id"),
                     (F.col("_seq") + 1).cast("int").alias("version"),
                     (F.col("event_type") != "error").alias("has_model"))


@query("latest_version", f"""
SELECT model_id, max(version) AS latest_version, max(version) FILTER (WHERE has_model) AS latest_with_model,
  max(version) + 1 AS next_version FROM {RUNS_SQL} GROUP BY model_id""")
def q_latest_version(spark, sf):
    from tabforge.sources.runs import version_summary
    return version_summary(runs_table(spark, sf))


@query("retention", f"""
SELECT model_id, version FROM (SELECT model_id, version, row_number() OVER (PARTITION BY model_id ORDER BY version DESC) AS r
FROM {RUNS_SQL}) WHERE r <= 4""")
def q_retention(spark, sf):
    from tabforge.sources.runs import retained_versions
    return retained_versions(runs_table(spark, sf), max_versions=5).select("model_id", "version")


# ------------------------------------------------------------------ X9 decode, T8 balanced sample, W8 frequency

@query("label_decode", """
WITH c AS (SELECT o_orderstatus AS cls, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS code
           FROM (SELECT DISTINCT o_orderstatus FROM orders))
SELECT o.o_orderkey, CAST(c.code AS INTEGER) AS code, coalesce(c2.cls, CAST(c.code AS VARCHAR)) AS code_decoded
FROM orders o JOIN c ON o.o_orderstatus = c.cls LEFT JOIN c c2 ON c2.code = c.code""")
def q_label_decode(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    classes = sorted(r[0] for r in o.select("o_orderstatus").distinct().collect())
    enc = R.label_encode(o, "o_orderstatus", "code", classes)
    return R.label_decode(enc, "code", classes).select("o_orderkey", F.col("code").cast("int").alias("code"),
                                                       "code_decoded")


@query("sample_balanced", f"""
WITH s AS (SELECT o_orderkey, actual <> predicted AS wrong, {HASH_FRAC_SQL.format(id='o_orderkey')} AS h FROM {ORD_PRED_SQL}),
w AS (SELECT o_orderkey FROM s WHERE wrong ORDER BY h, o_orderkey LIMIT 50)
SELECT o_orderkey FROM w UNION ALL
SELECT o_orderkey FROM (SELECT o_orderkey FROM s WHERE NOT wrong ORDER BY h, o_orderkey LIMIT (100 - (SELECT count(*) FROM w)))""")
def q_sample_balanced(spark, sf):
    from tabforge.operators.sampling import sample_balanced
    return sample_balanced(ord_pred(spark, sf), "actual", "predicted", ["o_orderkey"], 100).select("o_orderkey")


@query("freq_infer", """
WITH d AS (SELECT DISTINCT o_orderdate AS t FROM orders WHERE o_orderdate IS NOT NULL),
s AS (SELECT epoch(t) - lag(epoch(t)) OVER (ORDER BY t) AS step,
             (year(t) * 12 + month(t)) - lag(year(t) * 12 + month(t)) OVER (ORDER BY t) AS mstep FROM d),
a AS (SELECT min(step) AS smin, max(step) AS smax, min(mstep) AS mmin, max(mstep) AS mmax FROM s),
f AS (SELECT (SELECT count(*) FROM d) AS n, min(day(t)) AS dmin, max(day(t)) AS dmax,
             min(CASE WHEN CAST(t AS DATE) = last_day(t) THEN 1 ELSE 0 END) AS all_me,
             max(epoch_us(t) % 86400000000) AS tod, max(CASE WHEN isodow(t) >= 6 THEN 1 ELSE 0 END) AS weekend FROM d),
code AS (SELECT CASE
  WHEN n < 3 THEN NULL
  WHEN smin = smax AND smin = 1 THEN 'S' WHEN smin = smax AND smin = 60 THEN 'T'
  WHEN smin = smax AND smin = 3600 THEN 'H' WHEN smin = smax AND smin = 86400 THEN 'D'
  WHEN smin = smax AND smin = 604800 THEN 'W'
  WHEN mmin = mmax AND tod = 0 AND dmin = 1 AND dmax = 1 AND mmin IN (1, 3, 12) THEN
       CASE mmin WHEN 1 THEN 'MS' WHEN 3 THEN 'QS' ELSE 'AS' END
  WHEN mmin = mmax AND tod = 0 AND all_me = 1 AND mmin IN (1, 3, 12) THEN CASE mmin WHEN 1 THEN 'M' WHEN 3 THEN 'Q' ELSE 'A' END
  WHEN weekend = 0 AND tod = 0 AND smin = 86400 AND smax = 259200 THEN 'B'
  END AS c FROM a, f)
SELECT (SELECT count(DISTINCT o_orderdate) FROM orders) AS n_distinct, c AS inferred_freq, coalesce(c, 'D') AS freq,
  CASE coalesce(c, 'D') WHEN 'D' THEN 7 WHEN 'B' THEN 7 WHEN 'W' THEN 52 WHEN 'M' THEN 12 WHEN 'MS' THEN 12
    WHEN 'Q' THEN 4 WHEN 'QS' THEN 4 WHEN 'H' THEN 24 ELSE 1 END AS seasonal_period FROM code""")
def q_freq_infer(spark, sf):
    return S.frequency_table(t(spark, sf, "orders"), "o_orderdate")


# ------------------------------------------------------------------ J3, J4, M12, M20, M21 neighbours and CF table

EMB_SPLIT_SQL = f"(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x, {HASH_UNIT_SQL.format(id='vec_id')} < 0.2 AS is_test FROM embeddings)"


@query("knn_eps", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
n AS (SELECT count(*) AS n FROM e),
d AS (SELECT a.vec_id, list_distance(a.x, b.x) AS dist,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS r FROM e a, e b)
SELECT round(quantile_cont(dist, 0.5), 6) AS eps, (SELECT least(20, n - 1) FROM n) AS k FROM d
WHERE r = (SELECT least(20, n - 1) FROM n)""")
def q_knn_eps(spark, sf):
    from tabforge.operators import neighbors as NB
    e = t(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.count()
    eps = NB.estimate_eps(e, "vec_id", "embedding", 20)
    return rnd(spark.createDataFrame([(float(eps), int(min(20, n - 1)))], "eps double, k long"))


@query("dbscan_core", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
n AS (SELECT count(*) AS n FROM e),
d AS (SELECT a.vec_id, list_distance(a.x, b.x) AS dist,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS r FROM e a, e b),
eps AS (SELECT quantile_cont(dist, 0.5) AS eps FROM d WHERE r = (SELECT least(20, n - 1) FROM n)),
c AS (SELECT a.vec_id, count(*) AS n_neighbors FROM e a, e b, eps WHERE list_distance(a.x, b.x) <= eps.eps * (1 + 1e-9)
      GROUP BY a.vec_id)
SELECT vec_id, n_neighbors, n_neighbors >= (SELECT least(5, CAST(floor(n * 0.05) AS BIGINT) + 1) FROM n) AS core FROM c""")
def q_dbscan_core(spark, sf):
    from tabforge.operators import neighbors as NB
    e = t(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.count()
    eps = NB.estimate_eps(e, "vec_id", "embedding", 20)
    ms = min(5, int(n * 0.05) + 1)
    c = NB.range_counts(e, eps * (1 + 1e-9), "vec_id", "embedding")
    return c.withColumn("core", F.col("n_neighbors") >= ms)


#: DBSCAN by reachability: smallest core row reachable by core rows within eps, numbered in order.
DBSCAN_SQL = """
n AS (SELECT a.id AS a, b.id AS b FROM p a, p b WHERE list_distance(a.x, b.x) <= (SELECT eps FROM e)),
core AS (SELECT a AS id FROM n GROUP BY a HAVING count(*) >= (SELECT ms FROM e)),
l AS (SELECT a, b FROM n WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach(a, b) AS (SELECT id, id FROM core UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS c FROM (SELECT DISTINCT root FROM root)),
own AS (SELECT root.id, num.c FROM root JOIN num USING (root)),
edge AS (SELECT n.a AS id, min(own.c) AS c FROM n JOIN own ON own.id = n.b WHERE n.a NOT IN (SELECT id FROM core) GROUP BY n.a)
SELECT p.id, CAST(coalesce(own.c, edge.c, -1) AS INTEGER) AS cluster, own.c IS NOT NULL AS core
FROM p LEFT JOIN own ON own.id = p.id LEFT JOIN edge ON edge.id = p.id"""


@query("dbscan_grid", """
WITH RECURSIVE p AS (SELECT c_custkey AS id, [c_acctbal / 1000, CAST(c_nationkey AS DOUBLE) / 4] AS x FROM customer),
e AS (SELECT 0.3 AS eps, 6 AS ms),""" + DBSCAN_SQL)
def q_dbscan_grid(spark, sf):
    from tabforge.operators import neighbors as NB
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.array(
        F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double") / 4).alias("x"))
    return NB.dbscan(c, "id", "x", 0.3, 6)


@query("dbscan_vectors", """
WITH RECURSIVE p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
e AS (SELECT 0.6 AS eps, 4 AS ms),""" + DBSCAN_SQL)
def q_dbscan_vectors(spark, sf):
    from tabforge.operators import neighbors as NB
    return NB.dbscan(t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")), "id", "x", 0.6, 4)


@query("knn_weighted", f"""
WITH s AS {EMB_SPLIT_SQL},
tr AS (SELECT * FROM s WHERE NOT is_test), te AS (SELECT * FROM s WHERE is_test),
d AS (SELECT te.vec_id, tr.vec_id AS rid, tr.label, list_sum(list_transform(list_zip(te.x, tr.x), lambda z: abs(z[1] - z[2]))) AS dist FROM te, tr),
nn AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, rid) AS r FROM d),
z AS (SELECT *, max(dist = 0) OVER (PARTITION BY vec_id) AS zero FROM nn WHERE r <= 7),
v AS (SELECT vec_id, label, round(sum(CASE WHEN zero THEN CAST(dist = 0 AS INTEGER) ELSE 1 / dist END), 9) AS votes FROM z GROUP BY vec_id, label)
SELECT vec_id, min(label) AS prediction FROM (SELECT *, max(votes) OVER (PARTITION BY vec_id) AS mv FROM v) WHERE votes = mv
GROUP BY vec_id""")
def q_knn_weighted(spark, sf):
    from tabforge.functions.hashing import hash_unit
    from tabforge.operators import neighbors as NB
    e = t(spark, sf, "embeddings").withColumn("is_test", hash_unit(["vec_id"]) < 0.2)
    return NB.knn_classify(e.where(~F.col("is_test")), e.where("is_test"), 7, "vec_id", "embedding", "label", weights="distance", p=1)


@query("knn_classify", f"""
WITH s AS {EMB_SPLIT_SQL},
tr AS (SELECT * FROM s WHERE NOT is_test), te AS (SELECT * FROM s WHERE is_test),
nn AS (SELECT te.vec_id, tr.label, row_number() OVER (PARTITION BY te.vec_id ORDER BY list_distance(te.x, tr.x), tr.vec_id) AS r
       FROM te, tr),
v AS (SELECT vec_id, label, count(*) AS votes FROM nn WHERE r <= 5 GROUP BY vec_id, label)
SELECT vec_id, min(label) AS prediction FROM (SELECT *, max(votes) OVER (PARTITION BY vec_id) AS mv FROM v) WHERE votes = mv
GROUP BY vec_id""")
def q_knn_classify(spark, sf):
    from tabforge.functions.hashing import hash_unit
    from tabforge.operators import neighbors as NB
    e = t(spark, sf, "embeddings").withColumn("is_test", hash_unit(["vec_id"]) < 0.2)
    return NB.knn_classify(e.where(~F.col("is_test")), e.where("is_test"), 5, "vec_id", "embedding", "label")


@query("cf_table", """
WITH p AS (SELECT CAST(p_size AS DOUBLE) AS a0, p_retailprice AS a1 FROM part),
b AS (SELECT min(a0) AS lo0, max(a0) AS hi0, min(a1) AS lo1, max(a1) AS hi1 FROM p),
c AS (SELECT CAST(least(floor((a0 - lo0) / (coalesce(nullif(hi0 - lo0, 0), 1.0) / 32)), 31) AS BIGINT) AS c0,
             CAST(least(floor((a1 - lo1) / (coalesce(nullif(hi1 - lo1, 0), 1.0) / 32)), 31) AS BIGINT) AS c1, a0, a1 FROM p, b)
SELECT CAST(c0 AS VARCHAR) || ':' || CAST(c1 AS VARCHAR) AS cell, count(*) AS n, round(sum(a0), 4) AS ls0, round(sum(a1), 4) AS ls1,
  round(sum(a0 * a0 + a1 * a1), 2) AS ss FROM c GROUP BY c0, c1""")
def q_cf_table(spark, sf):
    from pyspark.ml.functions import array_to_vector
    from tabforge.plans.cluster import cf_summaries
    p = t(spark, sf, "part").select("p_partkey", array_to_vector(F.array(F.col("p_size").cast("double"),
                                                                        F.col("p_retailprice"))).alias("features"))
    cf = cf_summaries(p, "p_partkey")
    return cf.select("cell", "n", F.round(F.col("ls")[0], 4).alias("ls0"), F.round(F.col("ls")[1], 4).alias("ls1"),
                     F.round("ss", 2).alias("ss"))


# ------------------------------------------------------------------ model plans (rows-only checks)

def _docs_labels(spark, sf):
    lab = t(spark, sf, "labels").drop("toxic")
    docs = t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return lab.join(docs, "doc_id")


@query("train_regression")
def q_train_regression(spark, sf):
    from tabforge.plans.train import train_regression
    res = train_regression(t(spark, sf, "orders"), "o_totalprice", ["o_orderkey"],
                           models=("linear_regression", "ridge", "lasso", "elastic_net", "decision_tree",
                                   "random_forest", "gradient_boosting"))
    res.release()
    return res.leaderboard.drop("error", "train_seconds")


@query("train_classification")
def q_train_classification(spark, sf):
    from tabforge.plans.train import train_classification
    res = train_classification(_docs_labels(spark, sf), "quality", ["doc_id"],
                               models=("logistic_regression", "decision_tree", "random_forest", "gradient_boosting",
                                       "knn", "naive_bayes", "svm", "mlp"), balance="weights")
    res.release()
    return res.leaderboard.drop("error", "train_seconds")


@query("train_classification_smote")
def q_train_classification_smote(spark, sf):
    from tabforge.plans.train import train_classification
    res = train_classification(_docs_labels(spark, sf), "quality", ["doc_id"],
                               models=("logistic_regression", "naive_bayes"), balance="smote")
    res.release()
    return res.leaderboard.drop("error", "train_seconds")


@query("smote", """
WITH c AS (SELECT l.quality, count(*) AS n FROM labels l JOIN documents USING (doc_id) GROUP BY l.quality),
m AS (SELECT max(n) AS m FROM c)
SELECT quality, false AS synthetic, n FROM c
UNION ALL SELECT quality, true, m - n FROM c, m WHERE n < m AND n >= 2""")
def q_smote(spark, sf):
    from pyspark.ml.functions import array_to_vector
    from tabforge.operators.balance import smote
    e = t(spark, sf, "labels").join(t(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    f = e.select("doc_id", "quality", array_to_vector(F.array(F.ln(F.col("n_chars").cast("double") + 1),
                                                              F.col("toxic").cast("double"))).alias("features"))
    out = smote(f, "quality", "features", ["doc_id"])
    return out.groupBy("quality", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("train_cluster")
def q_train_cluster(spark, sf):
    from tabforge.plans.cluster import cluster
    res = cluster(t(spark, sf, "embeddings"), "vec_id", cols=["embedding"])
    res.release()
    return res.leaderboard.drop("error", "train_seconds")


@query("pca")
def q_pca(spark, sf):
    from tabforge.plans.cluster import cluster_features, pca_reduce
    feats, _ = cluster_features(t(spark, sf, "embeddings"), "vec_id", ["embedding"])
    _, load = pca_reduce(feats, 2)
    return load.drop("loadings")


@query("dbscan")
def q_dbscan(spark, sf):
    from tabforge.operators import neighbors as NB
    from tabforge.plans.cluster import cluster_features, pca_reduce
    feats, _ = cluster_features(t(spark, sf, "embeddings"), "vec_id", ["embedding"])
    red, _ = pca_reduce(feats, 2)
    n = red.count()
    eps = NB.estimate_eps(red, "vec_id", "features", 20)
    return NB.dbscan(red, "vec_id", "features", eps, min(5, int(n * 0.05) + 1))


@query("forecast")
def q_forecast(spark, sf):
    from tabforge.plans.forecast import forecast
    e = t(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    res = forecast(e, "ts", "value", ["user_id"], "event_id", horizon=7)
    return res.future


@query("arima")
def q_arima(spark, sf):
    from tabforge.plans.forecast import arima111
    e = t(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    s = R.split_chronological(e, "ts", "event_id", 0.8)
    coef, _, _ = arima111(s, "ts", "value", ["user_id"], "event_id")
    return coef


@query("random_search")
def q_random_search(spark, sf):
    from tabforge.plans.prepare import fit_preparation
    from tabforge.plans.search import random_search
    o = R.split_random(t(spark, sf, "orders"), ["o_orderkey"])
    train = o.where("split = 'train'")
    prep = fit_preparation(train, "o_totalprice", None, exclude=["o_orderkey", "split"])
    feats = prep.model.transform(train).select("o_orderkey", "label", "features")
    table, _ = random_search(feats, "regression", ["o_orderkey"], models=["ridge", "elastic_net"], n_iter=20, cv=5)
    return table


@query("score")
def q_score(spark, sf):
    from tabforge.plans.score import artifact_from, score
    from tabforge.plans.train import train_classification
    o = t(spark, sf, "orders")
    res = train_classification(o, "o_orderstatus", ["o_orderkey"], models=("logistic_regression",))
    run = artifact_from(res, o, "o_orderstatus", ["o_orderkey"])
    return score(run, o).metrics


@query("quick_train")
def q_quick_train(spark, sf):
    from tabforge.plans.custom import quick_train, validate_run
    rep = quick_train(t(spark, sf, "orders"), "o_orderstatus", ["o_orderkey"])
    rep["model_id"] = "orders-status"
    from datetime import datetime, timezone
    rep["timestamp"] = datetime.now(timezone.utc).isoformat()
    return validate_run(rep)


# ------------------------------------------------------------------ S1 / S3 sources round trip, S12 / X8 report

def _scratch(spark, name):
    import uuid
    from tabforge.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


ROUNDTRIP_SQL = """SELECT count(*) AS n_rows, count(DISTINCT o_orderstatus) AS n_status, round(sum(o_totalprice), 2) AS total_price,
  CAST(max(o_orderkey) AS BIGINT) AS max_key FROM orders"""


def _roundtrip(spark, sf, fmt):
    path = _scratch(spark, f"orders-{fmt}")
    IO.write_table(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, fmt)
    back = IO.read_table(spark, path, fmt=fmt)
    return back.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_orderstatus").alias("n_status"),
                    F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total_price"),
                    F.max(F.col("o_orderkey")).cast("long").alias("max_key"))


@query("csv_roundtrip", ROUNDTRIP_SQL)
def q_csv_roundtrip(spark, sf):
    return _roundtrip(spark, sf, "csv")


@query("json_roundtrip", ROUNDTRIP_SQL)
def q_json_roundtrip(spark, sf):
    return _roundtrip(spark, sf, "json")


@query("report_json")
def q_report_json(spark, sf):
    d = P.describe(t(spark, sf, "lineitem"), LI_NUM)
    return IO.report_json(d.withColumn("quartiles", F.array("p25", "p50", "p75")))


# ------------------------------------------------------------------ W3 moments, W10 rank-1, T3 top-k, H2 folds, H13

def _moments_sql():
    cols = []
    fr = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
    for f, agg in (("skew", "skewness"), ("kurt", "kurtosis")):
        cols.append(f"round(CASE WHEN count(value) {fr} = 7 THEN {agg}(value) {fr} END, 6) AS value_rolling_7_{f}")
    return "SELECT event_id, " + ", ".join(cols) + " FROM events"


@query("ts_rolling_moments", _moments_sql())
def q_ts_rolling_moments(spark, sf):
    e = t(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    return rnd(S.series_features(e, ["value"], ["ts", "event_id"], ["user_id"], lags=(), windows=(7,),
                                 funcs=("skew", "kurt"), diffs=()).drop("ts", "user_id", "value"))


@query("rank1_pick", """
SELECT event_type, arg_max(event_id, value * 1e6 - event_id * 1e-9) AS event_id, max(value) AS value FROM (
  SELECT event_type, event_id, value, max(value) OVER (PARTITION BY event_type) AS mx FROM events) WHERE value = mx
GROUP BY event_type""".replace("arg_max(event_id, value * 1e6 - event_id * 1e-9)", "min(event_id)"))
def q_rank1_pick(spark, sf):
    from tabforge.plans.train import rank1_per_group
    return rank1_per_group(t(spark, sf, "events"), "event_type", "value", "event_id").select(
        "event_type", "event_id", "value")


@query("bottom_classes_f1", CLASS_REPORT_SQL + """
SELECT label, round(f1, 6) AS f1 FROM f ORDER BY f1, label LIMIT 3""")
def q_bottom_classes(spark, sf):
    rep = M.class_report(ord_pred(spark, sf), "actual", "predicted")
    return rnd(rep.orderBy("f1", "label").limit(3).select("label", "f1"))


@query("top_error_pairs", f"""
SELECT actual, predicted, count(*) AS count FROM {ORD_PRED_SQL} WHERE actual <> predicted
GROUP BY 1, 2 ORDER BY count DESC, actual, predicted LIMIT 5""")
def q_top_error_pairs(spark, sf):
    pairs = M.misclassified_groups(ord_pred(spark, sf), "actual", "predicted").where("grouping = 'pair'")
    return pairs.orderBy(F.col("count").desc(), "actual", "predicted").limit(5).select("actual", "predicted", "count")


@query("cv_folds", """
SELECT CAST(CAST(('0x' || substr(md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR))), 1, 8)) AS BIGINT) % 5 AS INTEGER) AS fold,
  count(*) AS n_rows FROM orders GROUP BY 1""")
def q_cv_folds(spark, sf):
    from tabforge.functions.hashing import hash_fold
    return t(spark, sf, "orders").select(hash_fold(["o_orderkey"], 5).alias("fold")).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"))


@query("cv_folds_stratified", f"""
WITH r AS (SELECT o_orderkey, o_orderstatus, count(*) OVER (PARTITION BY o_orderstatus) AS n,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY {HASH_FRAC_SQL.format(id='o_orderkey')}) - 1 AS j FROM orders)
SELECT o_orderkey, CAST((j * 5 // n + CAST(('0x' || substr(md5(concat_ws('|', '42', o_orderstatus)), 1, 8)) AS BIGINT)) % 5 AS INTEGER) AS fold FROM r""")
def q_cv_folds_stratified(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return R.stratified_folds(o, "o_orderstatus", ["o_orderkey"]).drop("o_orderstatus")


@query("cv_folds_many_classes", f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_partkey) AS n, count(*) OVER (PARTITION BY l_partkey
  ORDER BY {HASH_FRAC_SQL.format(id="l_orderkey || '|' || l_linenumber")}) - 1 AS j FROM lineitem),
f AS (SELECT CAST((j * 5 // n + CAST(('0x' || substr(md5(concat_ws('|', '42', CAST(l_partkey AS VARCHAR))), 1, 8)) AS BIGINT)) % 5 AS INTEGER) AS fold,
  l_partkey FROM r)
SELECT l_partkey, fold, count(*) AS n_rows FROM f GROUP BY 1, 2""")
def q_cv_folds_many_classes(spark, sf):
    # the key repeats in this table: its rows go together to the fold of the last of them, in SQL by the frame that holds all peers
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return R.stratified_folds(rows, "l_partkey", ["l_orderkey", "l_linenumber"]).groupBy("l_partkey", "fold").agg(
        F.count(F.lit(1)).alias("n_rows"))


@query("weak_classes", CLASS_REPORT_SQL + """
SELECT label, recall < 0.5 AS low_recall,
  (SELECT count(*) FROM f) <= 10 AND precision < 0.7 AND recall < 0.7 AS weak FROM f""")
def q_weak_classes(spark, sf):
    from tabforge.plans.train import weak_classes
    return weak_classes(M.class_report(ord_pred(spark, sf), "actual", "predicted"))


@query("metric_ranges")
def q_metric_ranges(spark, sf):
    from tabforge.plans.train import metric_ranges, train_regression
    res = train_regression(t(spark, sf, "orders"), "o_totalprice", ["o_orderkey"],
                           models=("linear_regression", "ridge", "decision_tree"))
    res.release()
    return metric_ranges(res.leaderboard, ["r2", "rmse", "mae", "mape"])


@query("scoring_report")
def q_scoring_report(spark, sf):
    o = t(spark, sf, "orders")
    score_tbl = o.drop("o_orderpriority").withColumn(
        "o_totalprice", F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.col("o_totalprice"))) \
        .withColumn("o_comment", F.lit("new"))
    classes = o.select(F.col("o_orderstatus").alias("label")).distinct()
    return C.scoring_report(o.schema, score_tbl, "o_orderstatus", classes)


# ------------------------------------------------------------------ F18 full time-series feature set

def _ts_features_sql():
    cal = {
        "day_of_week": "CAST(isodow(ts) - 1 AS BIGINT)", "day_of_month": "CAST(day(ts) AS BIGINT)",
        "day_of_year": "CAST(dayofyear(ts) AS BIGINT)", "month": "CAST(month(ts) AS BIGINT)",
        "quarter": "CAST(quarter(ts) AS BIGINT)", "year": "CAST(year(ts) AS BIGINT)",
        "day_of_week_sin": "sin(2 * pi() * (isodow(ts) - 1) / 7)", "day_of_week_cos": "cos(2 * pi() * (isodow(ts) - 1) / 7)",
        "month_sin": "sin(2 * pi() * month(ts) / 12)", "month_cos": "cos(2 * pi() * month(ts) / 12)",
        "hour_sin": "sin(2 * pi() * hour(ts) / 24)", "hour_cos": "cos(2 * pi() * hour(ts) / 24)",
    }
    base = ("SELECT event_id, user_id, ts, value, " + ", ".join(f"{v} AS {k}" for k, v in cal.items())
            + " FROM events")
    w = "PARTITION BY user_id ORDER BY ts, event_id"
    cols = []
    for c in ["value", *cal]:
        x = f"CAST({c} AS DOUBLE)"
        for k in (1, 7, 14, 30):
            cols.append(f"round(lag({x}, {k}) OVER ({w}), 6) AS {c}_lag_{k}")
        for win in (7, 14, 30):
            fr = f"OVER ({w} ROWS BETWEEN {win - 1} PRECEDING AND CURRENT ROW)"
            for f, agg in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
                cols.append(f"round(CASE WHEN count({x}) {fr} = {win} THEN {agg}({x}) {fr} END, 6) AS {c}_rolling_{win}_{f}")
        for k in (1, 7):
            cols.append(f"round({x} - lag({x}, {k}) OVER ({w}), 6) AS {c}_diff_{k}")
    return f"SELECT event_id, {', '.join(cols)} FROM ({base})"


@query("ts_features", _ts_features_sql())
def q_ts_features(spark, sf):
    e = t(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    f = TF.ts_features(e, "ts", None, ["user_id"], "event_id")
    keep = [c for c in f.columns if "_lag_" in c or "_rolling_" in c or "_diff_" in c]
    return rnd(cut_features(f.select("event_id", *keep)))


def cut_features(df: DataFrame) -> DataFrame:
    """Materialise a very wide window projection once (keeps the optimizer's work small)."""
    from tabforge.session import cut_lineage
    return cut_lineage(df)


@query("forecast_single")
def q_forecast_single(spark, sf):
    """One unkeyed series derived from the data: daily order revenue (grows with the table)."""
    from tabforge.plans.forecast import forecast
    o = t(spark, sf, "orders")
    daily = o.groupBy(F.to_date("o_orderdate").cast("timestamp").alias("day")).agg(
        F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).alias("n_orders"))
    res = forecast(daily, "day", "revenue", horizon=7, models=("linear_regression", "ridge", "gradient_boosting"))
    return res.leaderboard.drop("error", "train_seconds")


@query("run_report")
def q_run_report(spark, sf):
    import datetime as dt
    from tabforge.plans.train import run_report, train_regression
    started = dt.datetime.now(dt.timezone.utc)
    o = t(spark, sf, "orders")
    res = train_regression(o, "o_totalprice", ["o_orderkey"], models=("linear_regression", "ridge"))
    rep = run_report(res, o, "orders-total", "o_totalprice", started, parameters={"models": "linear_regression,ridge"})
    res.release()
    return rep.drop("timestamp", "start_time", "end_time", "runtime_seconds")


@query("silhouette", """
WITH e AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
d AS (SELECT a.vec_id, a.label AS own, b.label AS cl, sum(list_distance(a.x, b.x)) AS s, count(*) AS n
      FROM e a, e b WHERE a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
p AS (SELECT vec_id, max(CASE WHEN cl = own THEN s / n END) AS a, min(CASE WHEN cl <> own THEN s / n END) AS b,
             max(CASE WHEN cl = own THEN n END) AS own_n FROM d GROUP BY vec_id)
SELECT round(avg(CASE WHEN own_n IS NOT NULL AND b IS NOT NULL THEN (b - a) / greatest(a, b) ELSE 0.0 END), 6) AS silhouette
FROM p""")
def q_silhouette(spark, sf):
    from tabforge.operators import neighbors as NB
    e = t(spark, sf, "embeddings")
    return rnd(NB.silhouette_euclidean(e, "vec_id", "embedding", "label"))


@query("silhouettes", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label, label % 3 AS third FROM embeddings),
l AS (SELECT vec_id, x, 'label' AS labelling, label AS cl FROM e UNION ALL SELECT vec_id, x, 'third', third FROM e),
d AS (SELECT a.labelling, a.vec_id, a.cl AS own, b.cl, sum(list_distance(a.x, b.x)) AS s, count(*) AS n
      FROM l a JOIN l b ON a.labelling = b.labelling AND a.vec_id <> b.vec_id GROUP BY 1, 2, 3, 4),
p AS (SELECT labelling, vec_id, max(CASE WHEN cl = own THEN s / n END) AS a, min(CASE WHEN cl <> own THEN s / n END) AS b FROM d GROUP BY 1, 2)
SELECT labelling, round(avg(CASE WHEN a IS NOT NULL AND b IS NOT NULL AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END), 6) AS silhouette
FROM p GROUP BY 1""")
def q_silhouettes(spark, sf):
    from tabforge.operators.silhouette import silhouettes
    e = t(spark, sf, "embeddings").withColumn("third", F.col("label") % 3)
    return rnd(silhouettes(e, "embedding", ["label", "third"]))
