"""User extension points (D1, D2), the run contract check (V6) and the quick default
trainer (V7)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F
from pyspark.errors import AnalysisException

_PIPELINES: dict[str, Callable] = {}

# Fields a run report must carry (the plug-in output contract).
REQUIRED_FIELDS = ("timestamp", "model_id", "target", "status", "best_model", "problem_type", "features")


def register_pipeline(name: str, fn: Callable) -> None:
    """Register a training function ``fn(df, target, model_id, config) -> dict``.
    The dict must hold the report fields and a ``leaderboard`` DataFrame."""
    _PIPELINES[name] = fn


def run_pipeline(name: str, df: DataFrame, target: str, model_id: str, config: dict | None = None) -> dict:
    if name not in _PIPELINES:
        raise KeyError(f"no pipeline registered as {name!r}")
    out = _PIPELINES[name](df, target, model_id, dict(config or {}))
    out.setdefault("timestamp", datetime.now(timezone.utc).isoformat())
    out.setdefault("model_id", model_id)
    out.setdefault("target", target)
    return out


def apply_feature_fn(df: DataFrame, fn: Callable[[DataFrame, dict], DataFrame], config: dict | None = None,
                     check_rows: bool = True) -> tuple[DataFrame, str | None]:
    """User feature engineering (D2): ``fn(df, config)``; on an analysis error, a missing
    column of the input or a changed row count, keep the original features and report why."""
    try:
        out = fn(df, dict(config or {}))
        out.schema  # forces analysis
    except (AnalysisException, Exception) as e:  # noqa: BLE001 - user code
        return df, f"feature function failed: {type(e).__name__}: {e}"
    if check_rows and out.count() != df.count():
        return df, "feature function changed the row count"
    return out, None


def validate_run(report: dict) -> DataFrame:
    """Contract checks of a run report (V6): required fields present, a leaderboard with a
    ``test`` metric column, the best model named in it. ``passed`` is the conjunction."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    rows = [(f"field:{f}", f in report and report[f] is not None) for f in REQUIRED_FIELDS]
    board = report.get("leaderboard")
    has_board = isinstance(board, DataFrame)
    rows.append(("leaderboard", has_board))
    if has_board:
        metric_cols = [c for c in board.columns if c in ("r2", "rmse", "accuracy", "silhouette", "mae")]
        rows.append(("leaderboard_metric", bool(metric_cols)))
        best = report.get("best_model")
        rows.append(("best_model_in_leaderboard",
                     bool(best) and board.where(F.col("model") == best).limit(1).count() == 1))
    rows.append(("passed", all(ok for _, ok in rows)))
    return spark.createDataFrame(rows, "check string, ok boolean")


def quick_train(df: DataFrame, target: str, id_cols, seed: int = 42) -> dict:
    """Default trainer (V7): fewer than 10 distinct target values -> classification, else
    regression; one random forest on an 80/20 hash split; accuracy or R^2."""
    from tabforge.plans.train import train_classification, train_regression
    nd = df.agg(F.count_distinct(F.col(target))).first()[0]
    if nd < 10:
        res = train_classification(df, target, id_cols, models=("random_forest",))
        metric = res.leaderboard.select("accuracy").first()[0]
        problem = "classification"
    else:
        res = train_regression(df, target, id_cols, models=("random_forest",))
        metric = res.leaderboard.select("r2").first()[0]
        problem = "regression"
    return {"problem_type": problem, "metric": metric, "result": res, "leaderboard": res.leaderboard,
            "best_model": res.best_model, "features": res.prep.slot_names, "status": "completed",
            "target": target}
