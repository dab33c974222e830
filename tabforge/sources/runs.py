"""Run versions and retention (S9-S11, S15) over a runs table (model_id, version, has_model).

Versions are rows of a table partitioned by (model_id, version), not directories: the
next version is ``max(version) + 1`` and retention keeps the newest ``max_versions - 1``
before a new run is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def version_summary(runs: DataFrame) -> DataFrame:
    """Per model: latest version, latest version that holds a model, and the next version."""
    return runs.groupBy("model_id").agg(
        F.max("version").alias("latest_version"),
        F.max(F.when(F.col("has_model"), F.col("version"))).alias("latest_with_model"),
        (F.max("version") + 1).alias("next_version"))


def retained_versions(runs: DataFrame, max_versions: int = 5) -> DataFrame:
    """Versions kept before writing a new one: the newest ``max_versions - 1`` per model.

    Per model, the cut-off is the version ranked ``max_versions - 1`` from the top,
    found with an aggregate over (model_id, version) counts instead of a per-model window,
    so a model with millions of runs does not fill one task.
    """
    keep = max_versions - 1
    v = runs.select("model_id", "version").distinct()
    # version numbers are dense per model in practice; the cut-off is robust to gaps:
    # rank = number of versions >= v, computed with the count of newer versions per model.
    cnt = v.groupBy("model_id").agg(F.count(F.lit(1)).alias("_n"), F.max("version").alias("_mx"),
                                    F.min("version").alias("_mn"))
    dense = (F.col("_mx") - F.col("_mn") + 1) == F.col("_n")
    j = runs.join(cnt, "model_id")
    kept_dense = j.where(dense & (F.col("version") > F.col("_mx") - keep))
    # gapped version lists: fall back to a ranked window (rare; bounded by that model's runs)
    from pyspark.sql import Window
    gapped = j.where(~dense).withColumn(
        "_r", F.dense_rank().over(Window.partitionBy("model_id").orderBy(F.col("version").desc())))
    kept_gapped = gapped.where(F.col("_r") <= keep).drop("_r")
    return kept_dense.unionByName(kept_gapped).drop("_n", "_mx", "_mn")


def save_model(model, path: str) -> None:
    """Persist a fitted PipelineModel."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


RUNS_SCHEMA = ("model_id string, version int, has_model boolean, created_at timestamp, problem string, "
               "best_model string, metrics map<string,double>, report string")


def append_run(spark, path: str, model_id: str, problem: str, best_model: str | None, metrics: dict,
               report: str = "", has_model: bool = True, max_versions: int = 5) -> int:
    """Add a run to the runs table at ``path`` (partitioned by model_id) as version
    max(version) + 1, after keeping only the newest ``max_versions - 1`` versions (S9, S10)."""
    import datetime as _dt
    from pyspark.sql.utils import AnalysisException
    try:
        runs = spark.read.parquet(path).where(F.col("model_id") == model_id)
        latest = runs.agg(F.max("version")).first()[0] or 0
    except AnalysisException:
        runs, latest = None, 0
    if runs is not None and latest:
        enforce_retention(spark, path, model_id, max_versions)
    version = latest + 1
    row = [(model_id, version, has_model, _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None), problem,
            best_model, {k: float(v) for k, v in (metrics or {}).items() if v is not None}, report)]
    spark.createDataFrame(row, RUNS_SCHEMA).write.mode("append").partitionBy("model_id").parquet(path)
    return version


def enforce_retention(spark, path: str, model_id: str, max_versions: int = 5) -> None:
    """Rewrite one model's partition with its newest ``max_versions - 1`` versions (dynamic
    partition overwrite touches only that model_id). The kept rows are materialised in the
    checkpoint folder first, so the source is never read while it is overwritten."""
    from tabforge.session import cut_lineage
    runs = spark.read.parquet(path).where(F.col("model_id") == model_id)
    kept = cut_lineage(retained_versions(runs, max_versions))
    prev = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        kept.select(*[c for c in runs.columns if c != "model_id"], "model_id") \
            .write.mode("overwrite").partitionBy("model_id").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev)


def latest_model_version(spark, path: str, model_id: str) -> int | None:
    """Highest version of ``model_id`` that holds a model."""
    r = spark.read.parquet(path).where((F.col("model_id") == model_id) & F.col("has_model")) \
             .agg(F.max("version")).first()[0]
    return r
