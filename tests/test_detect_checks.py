"""Problem-type decision list and input checks on micro tables."""

import datetime as dt

from pyspark.sql import functions as F

from tabforge.operators import checks as C
from tabforge.operators.detect import detect_problem_type


def test_decision_list(spark):
    ids = spark.range(200).withColumnRenamed("id", "seq")
    two = ids.withColumn("y", (F.col("seq") % 2).cast("double"))
    assert detect_problem_type(two, "y")["problem_type"] == "classification"
    regular = ids.withColumn("y", (F.col("seq") % 5).cast("double"))            # regular gaps, ratio < 0.1
    assert detect_problem_type(regular, "y")["problem_type"] == "classification"
    cont = ids.withColumn("y", F.col("seq") * 3.7 + F.sin("seq") * 100)
    assert detect_problem_type(cont, "y")["problem_type"] == "regression"
    many = ids.withColumn("y", (F.col("seq") % 40).cast("double"))              # > 20 classes
    assert detect_problem_type(many, "y")["problem_type"] == "regression"
    text = ids.withColumn("y", F.concat(F.lit("c"), (F.col("seq") % 3).cast("string")))
    assert detect_problem_type(text, "y")["problem_type"] == "classification"
    assert detect_problem_type(ids, None)["problem_type"] == "clustering"


def test_time_series_needs_monotone_order(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(days=i), float(i * 1.7 % 13)) for i in range(40)]
    df = spark.createDataFrame(rows, "seq long, ts timestamp, y double")
    assert detect_problem_type(df, "y", "seq")["problem_type"] == "time_series"
    shuffled = df.withColumn("seq", (F.col("seq") * 7) % 40)
    assert detect_problem_type(shuffled, "y", "seq")["problem_type"] != "time_series"


def test_id_detector(spark):
    rows = [(i, f"{i:08x}-0000-0000-0000-000000000000" if i == 3 else "v", i % 2, "x") for i in range(20)]
    df = spark.createDataFrame(rows, "row_id long, u string, b int, key string")
    r = {x["column_name"]: x["reason"] for x in C.id_columns(df).collect()}
    assert r == {"row_id": "all_unique", "u": "uuid_values", "b": None, "key": "id_name"}


def test_schema_checks(spark):
    train = spark.createDataFrame([(1, 2.0, "a", 1.0)], "id long, x double, s string, target double")
    score = spark.createDataFrame([(1, "oops", 5)], "id long, x string, extra int")
    rows = {(r["check"], r["column_name"]): r["status"] for r in C.schema_checks(train.schema, score, "target").collect()}
    assert rows == {("type_mismatch", "x"): "error", ("missing_column", "s"): "error", ("extra_column", "extra"): "warn"}


def test_validation_checks(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, y double")
    st = {r["check"]: r["status"] for r in C.validation_checks(df, "y", "regression").collect()}
    assert st["target_has_values"] == "error" and st["n_rows_at_least_10"] == "warn"
    one = spark.createDataFrame([(1, "a"), (2, "a")], "id long, y string")
    st = {r["check"]: r["status"] for r in C.validation_checks(one, "y", "classification").collect()}
    assert st["has_multiple_classes"] == "error"


def test_unexpected_classes(spark):
    tr = spark.createDataFrame([("a",), ("b",)], "y string")
    sc = spark.createDataFrame([("a",), ("c",), ("c",), (None,)], "y string")
    assert [(r["label"], r["n_rows"]) for r in C.unexpected_classes(tr, sc, "y").collect()] == [("c", 2)]
