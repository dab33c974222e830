"""Flagship: one real query end to end on ``orders`` -- profile, detect, split, prepare,
fit the linear / regularised / tree regressors, score the test split, rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabforge.operators.detect import detect_problem_type
from tabforge.plans.train import train_regression
from tabforge.sources.io import read_table

FLAGSHIP_MODELS = ("linear_regression", "ridge", "lasso", "elastic_net", "decision_tree")


def flagship(spark: SparkSession, sf_dir: str, models=FLAGSHIP_MODELS) -> DataFrame:
    orders = read_table(spark, f"{sf_dir}/orders.parquet")
    problem = detect_problem_type(orders, "o_totalprice")["problem_type"]
    if problem != "regression":
        raise ValueError(f"expected a regression target, detected {problem}")
    res = train_regression(orders, "o_totalprice", ["o_orderkey"], models=models)
    board = res.leaderboard
    res.release()                       # the leaderboard is a small local table; features can go
    return board.select(
        "model", "rank", "trained_successfully",
        *[F.round(c, 6).alias(c) for c in ("r2", "rmse", "mae", "mape", "train_r2")], "overfit")
