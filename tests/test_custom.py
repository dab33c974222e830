"""Plug-in registry (D1), feature functions (D2) and the run contract (V6)."""

from pyspark.sql import functions as F

from tabforge.plans import custom as CU


def test_registered_pipeline_and_contract(spark):
    def fn(df, target, model_id, config):
        board = df.groupBy(F.lit("mean_model").alias("model")).agg(F.avg(target).alias("r2"))
        return {"status": "completed", "best_model": "mean_model", "problem_type": "regression",
                "features": [c for c in df.columns if c != target], "leaderboard": board}

    CU.register_pipeline("mean", fn)
    df = spark.createDataFrame([(1, 2.0), (2, 4.0)], "id long, y double")
    rep = CU.run_pipeline("mean", df, "y", "m-1")
    checks = {r["check"]: r["ok"] for r in CU.validate_run(rep).collect()}
    assert checks["passed"] and checks["field:model_id"] and checks["best_model_in_leaderboard"]
    bad = dict(rep)
    bad.pop("status")
    assert not {r["check"]: r["ok"] for r in CU.validate_run(bad).collect()}["passed"]


def test_feature_fn_fallback(spark):
    df = spark.createDataFrame([(1, 2.0)], "id long, y double")
    ok, err = CU.apply_feature_fn(df, lambda d, c: d.withColumn("y2", F.col("y") * 2))
    assert err is None and "y2" in ok.columns
    same, err = CU.apply_feature_fn(df, lambda d, c: d.select("missing_column"))
    assert err is not None and same.columns == df.columns
    same, err = CU.apply_feature_fn(df, lambda d, c: d.union(d))
    assert err == "feature function changed the row count"
