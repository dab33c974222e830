"""Evaluation metrics and prediction profiles as DataFrame aggregates.

All metrics are computed from distributed aggregates over the scored table. Where an
ordering over all rows is needed (ROC-AUC, average precision) the table is first
reduced to one row per distinct score and processed in score buckets with carried
totals, never as one global window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabforge.operators.clusterscores import clustering_scores, silhouette_squared  # noqa: F401 - part of this module's interface
from tabforge.operators.quantiles import exact_quantiles
from tabforge.session import ship_package
from tabforge.functions.scalars import attach

EPS = 2.220446049250313e-16          # fixed value: float64 machine epsilon used by MAPE


# ---------------------------------------------------------------- E1-E3 regression

def regression_metrics(df: DataFrame, actual: str, pred: str) -> DataFrame:
    """n, mse, rmse, mae, r2 (1 - SSE/SST), mape (fraction, |y| floored at eps)."""
    y = F.col(actual).cast("double")
    p = F.col(pred).cast("double")
    e = y - p
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.avg(F.abs(e)).alias("mae"),
                 F.var_pop(y).alias("vy"), F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(EPS))).alias("mape"))
    return agg.select(
        "n", (F.col("sse") / F.col("n")).alias("mse"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
        "mae",
        F.when(F.col("vy") > 0, 1 - F.col("sse") / (F.col("vy") * F.col("n"))).otherwise(F.lit(0.0)).alias("r2"),
        "mape")


def error_stats(df: DataFrame, actual: str, pred: str) -> DataFrame:
    """Residual (actual - prediction) statistics (A18): mean, median, population std,
    mean / median absolute, min, max, q1, q3."""
    r = df.select((F.col(actual).cast("double") - F.col(pred).cast("double")).alias("residual")) \
          .withColumn("abs_residual", F.abs("residual"))
    q = exact_quantiles(r, ["residual", "abs_residual"], (0.25, 0.5, 0.75))
    return r.agg(F.avg("residual").alias("mean_error"), F.stddev_pop("residual").alias("std_error"),
                 F.avg("abs_residual").alias("mean_abs_error"), F.min("residual").alias("min_error"),
                 F.max("residual").alias("max_error")).select(
        "mean_error", F.lit(q[("residual", 0.5)]).alias("median_error"), "std_error", "mean_abs_error",
        F.lit(q[("abs_residual", 0.5)]).alias("median_abs_error"), "min_error", "max_error",
        F.lit(q[("residual", 0.25)]).alias("q1_error"), F.lit(q[("residual", 0.75)]).alias("q3_error"))


RESIDUAL_PROBS = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)   # fixed values: residual percentiles reported


def residual_percentiles(df: DataFrame, actual: str, pred: str, probs=RESIDUAL_PROBS) -> DataFrame:
    """p25..p99 of the residual and of its absolute value (A19), long form (p, residual, abs_residual)."""
    r = df.select((F.col(actual).cast("double") - F.col(pred).cast("double")).alias("residual")) \
          .withColumn("abs_residual", F.abs("residual"))
    q = exact_quantiles(r, ["residual", "abs_residual"], probs)
    rows = [(int(round(p * 100)), q[("residual", p)], q[("abs_residual", p)]) for p in probs]
    return df.sparkSession.createDataFrame(rows, "percentile int, residual double, abs_residual double")


def extreme_errors(df: DataFrame, actual: str, pred: str) -> DataFrame:
    """Share of rows with |e| > 3 std_pop(e) and with |e| > p95(|e|)."""
    r = df.select((F.col(actual).cast("double") - F.col(pred).cast("double")).alias("e"))
    p95 = exact_quantiles(r.select(F.abs("e").alias("a")), ["a"], (0.95,))[("a", 0.95)]
    sd = r.agg(F.stddev_pop("e").alias("sd"))
    return attach(r, sd).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.abs("e") > 3 * F.col("sd"), 1).otherwise(0)).cast("long").alias("n_extreme"),
        F.sum(F.when(F.abs("e") > p95, 1).otherwise(0)).cast("long").alias("n_large"),
    ).select("n", "n_extreme", (F.col("n_extreme") * 100.0 / F.col("n")).alias("extreme_pct"),
             "n_large", (F.col("n_large") * 100.0 / F.col("n")).alias("large_pct"),
             F.lit(p95).alias("p95_abs_error"))


def prediction_stats(df: DataFrame, pred: str) -> DataFrame:
    """min, max, mean, population std of predictions."""
    p = F.col(pred).cast("double")
    return df.agg(F.min(p).alias("pred_min"), F.max(p).alias("pred_max"), F.avg(p).alias("pred_mean"),
                  F.stddev_pop(p).alias("pred_std"))


# ---------------------------------------------------------------- E4-E6, E8 classification

def confusion(df: DataFrame, actual: str, pred: str) -> DataFrame:
    """Non-zero cells of the confusion matrix: (actual, predicted, count), labels as strings."""
    return df.groupBy(F.col(actual).cast("string").alias("actual"),
                      F.col(pred).cast("string").alias("predicted")).agg(F.count(F.lit(1)).alias("count"))


def class_report(df: DataFrame, actual: str, pred: str) -> DataFrame:
    """Per class precision, recall, f1 (zero_division = 0) and support over the label
    universe (union of actual and predicted labels). One pass over the scored rows: every
    confusion cell adds to the support of its actual label, to the predictions of its
    predicted label and, on the diagonal, to the true positives."""
    cm = confusion(df, actual, pred)
    n = F.col("count")
    diag = F.col("actual") == F.col("predicted")
    contrib = F.array(
        F.struct(F.col("actual").alias("label"), n.alias("s"), F.lit(0).cast("long").alias("p"),
                 F.when(diag, n).otherwise(0).cast("long").alias("t")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("s"), n.alias("p"),
                 F.lit(0).cast("long").alias("t")))
    rep = cm.select(F.inline(contrib)).groupBy("label").agg(
        F.sum("s").alias("support"), F.sum("p").alias("n_predicted"), F.sum("t").alias("tp"))
    precision = F.when(F.col("n_predicted") > 0, F.col("tp") / F.col("n_predicted")).otherwise(F.lit(0.0))
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    rep = rep.select("label", precision.alias("precision"), recall.alias("recall"),
                     F.col("support").cast("long").alias("support"),
                     F.col("n_predicted").cast("long").alias("n_predicted"), F.col("tp").cast("long").alias("tp"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return rep.withColumn("f1", f1)


def classification_metrics(df: DataFrame, actual: str, pred: str) -> DataFrame:
    """accuracy, balanced accuracy (mean recall over classes present in actual), macro /
    weighted / micro precision, recall, f1; and for two labels the binary trio with the
    second label in sort order as positive."""
    rep = class_report(df, actual, pred)
    agg = rep.agg(
        F.sum("support").alias("n"), F.sum("tp").alias("correct"), F.count(F.lit(1)).alias("n_labels"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision_weighted"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall_weighted"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.max_by(F.struct("precision", "recall", "f1"), "label").alias("pos"))
    acc = F.col("correct") / F.col("n")
    binary = F.col("n_labels") == 2
    return agg.select(
        "n", acc.alias("accuracy"), "balanced_accuracy",
        "precision_macro", "recall_macro", "f1_macro",
        "precision_weighted", "recall_weighted", "f1_weighted",
        acc.alias("precision_micro"), acc.alias("recall_micro"), acc.alias("f1_micro"),
        F.when(binary, F.col("pos.precision")).alias("precision_binary"),
        F.when(binary, F.col("pos.recall")).alias("recall_binary"),
        F.when(binary, F.col("pos.f1")).alias("f1_binary"))


def model_metrics(df: DataFrame, group: Sequence[str], actual: str, pred: str, prob_true: str,
                  positive: str | None = None, eps: float = 1e-15) -> DataFrame:
    """Per ``group`` (model and split, say): accuracy, balanced accuracy, macro and weighted precision, recall and f1,
    the log loss of the probability ``prob_true`` of the actual class (NULL without one), and with a ``positive``
    label its precision, recall, f1 and MCC. One pass over the rows; the rest works on confusion cells."""
    group = list(group)
    p = F.least(F.greatest(F.col(prob_true).cast("double"), F.lit(eps)), F.lit(1 - eps))
    cells = df.groupBy(*group, F.col(actual).cast("string").alias("__a"), F.col(pred).cast("string").alias("__p")).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(-F.ln(p)).alias("__ll"), F.count(F.col(prob_true)).alias("__lp"))
    n, zero = F.col("__n"), F.lit(0).cast("long")
    contrib = F.array(
        F.struct(F.col("__a").alias("label"), n.alias("s"), zero.alias("p"),
                 F.when(F.col("__a") == F.col("__p"), n).otherwise(zero).alias("t"), F.col("__ll").alias("ll"), F.col("__lp").alias("lp")),
        F.struct(F.col("__p").alias("label"), zero.alias("s"), n.alias("p"), zero.alias("t"),
                 F.lit(None).cast("double").alias("ll"), zero.alias("lp")))
    rep = cells.select(*group, F.inline(contrib)).groupBy(*group, "label").agg(
        *[F.sum(c).alias(c) for c in ("s", "p", "t", "ll", "lp")])
    rep = rep.withColumn("precision", F.when(F.col("p") > 0, F.col("t") / F.col("p")).otherwise(F.lit(0.0)))
    rep = rep.withColumn("recall", F.when(F.col("s") > 0, F.col("t") / F.col("s")).otherwise(F.lit(0.0)))
    both = F.col("precision") + F.col("recall")
    rep = rep.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))
    kinds = ("precision", "recall", "f1")
    is_pos = F.col("label") == F.lit(positive) if positive is not None else F.lit(False)
    out = rep.groupBy(*group).agg(
        F.sum("s").alias("n"), (F.sum("t") / F.sum("s")).alias("accuracy"),
        F.avg(F.when(F.col("s") > 0, F.col("recall"))).alias("balanced_accuracy"),
        *[F.avg(c).alias(f"{c}_macro") for c in kinds],
        *[(F.sum(F.col(c) * F.col("s")) / F.sum("s")).alias(f"{c}_weighted") for c in kinds],
        *[F.max(F.when(is_pos, F.col(c))).alias(f"{c}_binary") for c in kinds],
        F.try_divide(F.sum("ll"), F.sum("lp")).alias("log_loss"),
        *[F.max(F.when(is_pos, F.col(c).cast("double"))).alias(f"__{c}") for c in ("s", "p", "t")])
    tp, fp, fn = F.col("__t"), F.col("__p") - F.col("__t"), F.col("__s") - F.col("__t")
    tn = F.col("n") - tp - fp - fn
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = F.when(den > 0, (tp * tn - fp * fn) / den).when(den.isNotNull(), F.lit(0.0))
    return out.withColumn("mcc", mcc).drop("__s", "__p", "__t")


def binary_counts(df: DataFrame, actual: str, pred: str) -> DataFrame:
    """tp, fp, fn, tn with positive = second label in sorted order, plus MCC."""
    labels = df.select(F.col(actual).cast("string").alias("l")).union(
        df.select(F.col(pred).cast("string").alias("l"))).distinct()
    pos = labels.agg(F.max("l").alias("pos"), F.count(F.lit(1)).alias("n_labels"))
    a = F.col(actual).cast("string") == F.col("pos")
    p = F.col(pred).cast("string") == F.col("pos")
    c = attach(df, pos).agg(
        F.first("pos").alias("positive_label"),
        F.sum(F.when(a & p, 1).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.when(~a & p, 1).otherwise(0)).cast("long").alias("fp"),
        F.sum(F.when(a & ~p, 1).otherwise(0)).cast("long").alias("fn"),
        F.sum(F.when(~a & ~p, 1).otherwise(0)).cast("long").alias("tn"))
    tp, fp, fn, tn = [F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn")]
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.withColumn("mcc", F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(F.lit(0.0)))


def log_loss(df: DataFrame, prob_true: str, eps: float = 1e-15) -> DataFrame:
    """Mean of -ln(p) of the probability given to the true class, clipped to [eps, 1-eps]."""
    p = F.least(F.greatest(F.col(prob_true).cast("double"), F.lit(eps)), F.lit(1 - eps))
    return df.agg(F.avg(-F.ln(p)).alias("log_loss"))


# ---- ranking metrics over distinct scores, in buckets with carried totals

def _score_table(df: DataFrame, label: str, score: str, positive) -> DataFrame:
    is_pos = F.col(label).cast("string") == F.lit(str(positive))
    return df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(F.when(is_pos, 1).otherwise(0)).cast("double").alias("pos"),
        F.sum(F.when(is_pos, 0).otherwise(1)).cast("double").alias("neg"))


def _bucketed(sc: DataFrame, buckets: int) -> tuple[DataFrame, list]:
    """Assign every distinct score to one of ~``buckets`` contiguous score ranges."""
    from pyspark.ml.feature import Bucketizer
    qs = sc.approxQuantile("s", [i / buckets for i in range(1, buckets)], 0.001)
    splits = sorted(set(qs))
    splits = [-math.inf] + splits + [math.inf]
    b = Bucketizer(splits=splits, inputCol="s", outputCol="bucket", handleInvalid="keep").transform(sc)
    return b, splits


def _rank_partial(pdf):
    """AUC numerator and AP sum of one score bucket, given the totals carried in from the
    buckets below (negatives) and above (positives and negatives)."""
    import numpy as np
    import pandas as pd
    up = pdf.sort_values("s")
    pos, neg = up["pos"].to_numpy(), up["neg"].to_numpy()
    neg_below = np.cumsum(neg) - neg + up["neg_below"].to_numpy()
    u = float((pos * (neg_below + 0.5 * neg)).sum())
    down = pdf.sort_values("s", ascending=False)
    pos, neg = down["pos"].to_numpy(), down["neg"].to_numpy()
    tp = np.cumsum(pos) + down["pos_above"].to_numpy()
    fp = np.cumsum(neg) + down["neg_above"].to_numpy()
    return pd.DataFrame({"u": [u], "ap": [float((pos * tp / (tp + fp)).sum())]})


def ranking_metrics(df: DataFrame, label: str, score: str, positive=None, buckets: int = 256) -> DataFrame:
    """ROC-AUC (Mann-Whitney with ties counted 1/2) and average precision
    (sum over descending distinct thresholds of recall step x precision), exact."""
    spark = df.sparkSession
    if positive is None:
        positive = df.select(F.max(F.col(label).cast("string"))).first()[0]
    ship_package(spark)
    sc = _score_table(df, label, score, positive)
    # one pandas group per score bucket: keep every bucket near a million distinct scores at most
    buckets = max(buckets, math.ceil(sc.count() / 1_000_000))
    b, _ = _bucketed(sc, buckets)
    b = b.persist()
    tot = b.groupBy("bucket").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn")).collect()
    tot = sorted((r["bucket"], r["bp"], r["bn"]) for r in tot)
    n_pos = sum(t[1] for t in tot)
    n_neg = sum(t[2] for t in tot)
    carries, below_n = [], 0.0
    above = {}
    run_p = run_n = 0.0
    for bk, bp, bn in reversed(tot):
        above[bk] = (run_p, run_n)
        run_p += bp
        run_n += bn
    for bk, bp, bn in tot:
        carries.append((bk, below_n, above[bk][0], above[bk][1]))
        below_n += bn
    cdf = spark.createDataFrame(carries, "bucket double, neg_below double, pos_above double, neg_above double")
    j = b.join(F.broadcast(cdf), "bucket")     # one row per bucket: bounded by ``buckets``
    part = j.groupBy("bucket").applyInPandas(_rank_partial, "u double, ap double") \
            .agg(F.sum("u").alias("u"), F.sum("ap").alias("ap")).first()
    auc_u, ap_sum = part["u"], part["ap"]
    b.unpersist()
    auc = (auc_u / (n_pos * n_neg)) if n_pos and n_neg else None
    ap = (ap_sum / n_pos) if n_pos else None
    return spark.createDataFrame([(str(positive), int(n_pos), int(n_neg), auc, ap)],
                                 "positive_label string, n_pos long, n_neg long, roc_auc double, average_precision double")


# ---------------------------------------------------------------- A16, A22, A24, A25

def outcome_summary(df: DataFrame, actual: str, pred: str) -> DataFrame:
    """correct / incorrect / total / accuracy."""
    ok = F.col(actual).cast("string") == F.col(pred).cast("string")
    return df.agg(F.sum(F.when(ok, 1).otherwise(0)).cast("long").alias("correct"),
                  F.sum(F.when(ok, 0).otherwise(1)).cast("long").alias("incorrect"),
                  F.count(F.lit(1)).alias("total")).withColumn("accuracy", F.col("correct") / F.col("total"))


def misclassified_groups(df: DataFrame, actual: str, pred: str) -> DataFrame:
    """Counts of wrong predictions by actual, by predicted and by pair (A16), long form."""
    wrong = df.where(F.col(actual).cast("string") != F.col(pred).cast("string")).select(
        F.col(actual).cast("string").alias("a"), F.col(pred).cast("string").alias("p"))
    pairs = wrong.groupBy("a", "p").agg(F.count(F.lit(1)).alias("count"))
    by_a = pairs.groupBy("a").agg(F.sum("count").alias("count")).select(
        F.lit("actual").alias("grouping"), F.col("a").alias("actual"), F.lit(None).cast("string").alias("predicted"), "count")
    by_p = pairs.groupBy("p").agg(F.sum("count").alias("count")).select(
        F.lit("predicted").alias("grouping"), F.lit(None).cast("string").alias("actual"), F.col("p").alias("predicted"), "count")
    by_pair = pairs.select(F.lit("pair").alias("grouping"), F.col("a").alias("actual"), F.col("p").alias("predicted"), "count")
    return by_a.unionByName(by_p).unionByName(by_pair).withColumn("count", F.col("count").cast("long"))


def never_predicted(df: DataFrame, actual: str, pred: str) -> DataFrame:
    """Actual classes that were never predicted."""
    a = df.select(F.col(actual).cast("string").alias("label")).distinct()
    p = df.select(F.col(pred).cast("string").alias("label")).distinct()
    return a.join(p, "label", "left_anti")


def confidence_profile(df: DataFrame, actual: str, pred: str, prob: str, low: float = 0.7) -> DataFrame:
    """Mean max-probability, rows below ``low``, mean probability when right / wrong."""
    ok = F.col(actual).cast("string") == F.col(pred).cast("string")
    p = F.col(prob).cast("double")
    return df.agg(F.avg(p).alias("mean_confidence"),
                  F.sum(F.when(p < low, 1).otherwise(0)).cast("long").alias("n_low_confidence"),
                  F.avg(F.when(ok, p)).alias("mean_confidence_correct"),
                  F.avg(F.when(~ok, p)).alias("mean_confidence_incorrect"))


# ---------------------------------------------------------------- A14 / A15 drift

def mean_drift(df: DataFrame, cols: Sequence[str], split_col: str = "split", threshold: float = 10.0) -> DataFrame:
    """|mean_train - mean_test| / |mean_train| * 100 per column, warn above ``threshold``."""
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [F.avg(F.when(F.col(split_col) == "train", v)).alias(f"tr{i}"),
                 F.avg(F.when(F.col(split_col) == "test", v)).alias(f"te{i}")]
    row = df.agg(*aggs)
    stack = ", ".join(f"'{c}', tr{i}, te{i}" for i, c in enumerate(cols))
    long = row.selectExpr(f"stack({len(cols)}, {stack}) AS (column_name, train_mean, test_mean)")
    diff = F.when(F.col("train_mean") != 0,
                  F.abs(F.col("train_mean") - F.col("test_mean")) / F.abs(F.col("train_mean")) * 100)
    return long.withColumn("drift_pct", diff).withColumn("warn", F.coalesce(F.col("drift_pct") > threshold, F.lit(False)))


def class_share_drift(df: DataFrame, target: str, split_col: str = "split") -> DataFrame:
    """Per class share (%) in train and test, their difference in points (A15); classes absent
    from one side count as 0 %."""
    c = F.col(target).cast("string")
    counts = df.where(F.col(target).isNotNull()).groupBy(c.alias("cls")).agg(
        F.sum(F.when(F.col(split_col) == "train", 1).otherwise(0)).alias("n_train"),
        F.sum(F.when(F.col(split_col) == "test", 1).otherwise(0)).alias("n_test"))
    tot = counts.agg(F.sum("n_train").alias("t_train"), F.sum("n_test").alias("t_test"))
    j = attach(counts, tot)
    tr = F.when(F.col("t_train") > 0, F.col("n_train") * 100.0 / F.col("t_train")).otherwise(F.lit(0.0))
    te = F.when(F.col("t_test") > 0, F.col("n_test") * 100.0 / F.col("t_test")).otherwise(F.lit(0.0))
    return j.select("cls", tr.alias("train_pct"), te.alias("test_pct"), F.abs(tr - te).alias("diff_pct"))


# ---------------------------------------------------------------- A17, E9-E12 clustering

def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    """Per label count and share, noise = -1 included."""
    return df.groupBy(F.col(label).alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
