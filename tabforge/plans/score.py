"""Batch scoring of a new table with a trained run.

load -> validate (warnings never stop scoring) -> transform with the saved pipeline ->
prediction columns (decoded class, max class probability, actual, residual) -> metrics
as aggregates -> deterministic samples -> optional writes of predictions and metrics.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabforge.operators import checks as C
from tabforge.operators import metrics as M
from tabforge.operators import sampling as SM
from tabforge.functions.scalars import attach


@dataclass
class RunArtifact:
    """What scoring needs from a training run: the fitted pipeline and its metadata."""
    pipeline: PipelineModel
    problem: str
    target: str
    classes: list | None
    train_schema: T.StructType
    id_cols: list

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        meta = {"problem": self.problem, "target": self.target, "classes": self.classes,
                "train_schema": self.train_schema.json(), "id_cols": self.id_cols}
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite") \
             .json(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "RunArtifact":
        meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
        return RunArtifact(PipelineModel.load(f"{path}/pipeline"), meta["problem"], meta["target"], meta["classes"],
                           T.StructType.fromJson(json.loads(meta["train_schema"])), meta["id_cols"])


def artifact_from(result, df: DataFrame, target: str, id_cols) -> RunArtifact:
    """Build the artifact of a TrainResult (preparation + best model)."""
    return RunArtifact(result.pipeline(), result.problem, target,
                       [str(c) for c in result.prep.label_classes] if result.prep.label_classes else None,
                       df.schema, list(id_cols))


@dataclass
class ScoreResult:
    predictions: DataFrame
    metrics: DataFrame | None
    checks: DataFrame
    samples: DataFrame | None


def score(run: RunArtifact, df: DataFrame, sample_size: int = 100) -> ScoreResult:
    target = run.target
    has_target = target in df.columns
    classes_df = None
    if run.classes is not None:
        classes_df = df.sparkSession.createDataFrame([(c,) for c in run.classes], "label string")
    checks = C.scoring_report(run.train_schema, df, target if has_target else None, classes_df)
    data = df
    if not has_target:
        data = df.withColumn(target, F.lit(None).cast(run.train_schema[target].dataType))
    # columns missing from the scoring table are added as NULL (imputation fills them)
    for f in run.train_schema.fields:
        if f.name not in data.columns:
            data = data.withColumn(f.name, F.lit(None).cast(f.dataType))
    out = run.pipeline.transform(data)
    keep = [c for c in df.columns]
    if run.problem == "classification":
        dec = F.create_map(*[x for i, c in enumerate(run.classes) for x in (F.lit(float(i)), F.lit(c))])
        cols = [F.col(f"`{c}`") for c in keep] + [dec[F.col("prediction")].alias("prediction"),
                                                  F.col("prediction").cast("int").alias("prediction_encoded")]
        if "probability" in out.columns:
            cols.append(F.array_max(vector_to_array("probability")).alias("prediction_probability"))
        if has_target:
            cols.append(F.col(target).cast("string").alias("actual"))
        preds = out.select(*[c for c in cols if not (isinstance(c, str))])
    else:
        cols = [F.col(f"`{c}`") for c in keep] + [F.col("prediction")]
        if has_target:
            cols += [F.col(target).cast("double").alias("actual"),
                     (F.col(target).cast("double") - F.col("prediction")).alias("residual")]
        preds = out.select(*cols)
    preds = preds.drop(target) if has_target and target in preds.columns else preds
    metrics, samples = None, None
    if has_target:
        metrics = score_metrics(preds, run.problem)
        if run.problem == "classification":
            samples = SM.sample_balanced(preds, "actual", "prediction", run.id_cols, sample_size)
        else:
            samples = SM.sample_high_residual(preds, "actual", "prediction", run.id_cols, sample_size)
    elif run.id_cols:
        samples = SM.sample_hash(preds, run.id_cols, sample_size)
    return ScoreResult(preds, metrics, checks, samples)


def score_metrics(preds: DataFrame, problem: str) -> DataFrame:
    """V5: regression r2, rmse, mae and mape (only when min |y| > 0); classification
    accuracy plus the binary trio for two labels or the macro trio otherwise."""
    if problem == "regression":
        base = M.regression_metrics(preds, "actual", "prediction")
        miny = preds.agg(F.min(F.abs("actual")).alias("m"))
        return attach(base, miny).select("r2", "rmse", "mae", F.when(F.col("m") > 0, F.col("mape")).alias("mape"))
    cm = M.classification_metrics(preds, "actual", "prediction")
    return cm.select("accuracy",
                     F.coalesce("precision_binary", "precision_macro").alias("precision"),
                     F.coalesce("recall_binary", "recall_macro").alias("recall"),
                     F.coalesce("f1_binary", "f1_macro").alias("f1"))


def write_outputs(result: ScoreResult, path: str, fmt: str = "parquet") -> None:
    """Write predictions and metrics (the predictions file the reference demanded but never wrote)."""
    from tabforge.sources.io import write_table
    write_table(result.predictions, f"{path}/predictions", fmt)
    if result.metrics is not None:
        write_table(result.metrics, f"{path}/metrics", fmt)
    write_table(result.checks, f"{path}/checks", fmt)
