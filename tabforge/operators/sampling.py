"""Deterministic samples (T5-T8): md5-ranked instead of seeded RNG draws.

Every sample is a bounded top-k by row hash (``orderBy(h).limit(k)`` plans as a
per-partition top-k plus a merge of k rows per partition) or a per-class hash
threshold found as an exact order statistic, so no class is collected into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabforge.functions.hashing import hash_fraction_expr
from tabforge.operators.quantiles import exact_quantiles, order_statistics


def sample_hash(df: DataFrame, id_cols: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows with the smallest md5('seed|id') (T5)."""
    return (df.withColumn("__h", hash_fraction_expr(id_cols, seed))
            .orderBy("__h", *id_cols).limit(n).drop("__h"))


def _per_class_first(df: DataFrame, cls: str, per: int, id_cols: Sequence[str]) -> DataFrame:
    """Rows with the ``per`` smallest hashes in each class (ties broken by the id)."""
    long = df.select(F.col(cls).cast("string").alias("column_name"), F.col("__h").alias("v"))
    counts = {r["column_name"]: r["n"] for r in long.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranks = {c: (c, min(per, n) - 1) for c, n in counts.items() if n > 0}
    thr = order_statistics(long, ranks)
    if not thr:
        return df.limit(0)
    tmap = F.create_map(*[x for c, v in thr.items() for x in (F.lit(c), F.lit(float(v)))])
    return df.where(F.col("__h") <= tmap[F.col(cls).cast("string")])


def sample_error_biased(df: DataFrame, actual: str, pred: str, id_cols: Sequence[str], n: int = 1000,
                        seed: int = 42) -> DataFrame:
    """Up to n/2 misclassified rows spread over actual classes (max(1, quota // classes) per
    class by hash, the remainder of the quota by hash among the other wrong rows), then
    correct rows by hash up to ``n`` in total (T6)."""
    quota = n // 2
    h = df.withColumn("__h", hash_fraction_expr(id_cols, seed)) \
          .withColumn("__wrong", F.col(actual).cast("string") != F.col(pred).cast("string"))
    wrong = h.where("__wrong")
    stats = wrong.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(actual)).alias("k")).first()
    if stats["n"] == 0:
        picked_wrong = wrong.limit(0)
    else:
        per = max(1, quota // stats["k"])
        first = _per_class_first(wrong, actual, per, id_cols)
        n_first = first.count()
        rest = max(0, min(quota, stats["n"]) - n_first)
        fill = wrong.join(first.select(*id_cols), list(id_cols), "left_anti").orderBy("__h", *id_cols).limit(rest)
        picked_wrong = first.unionByName(fill)
    n_wrong = picked_wrong.count()
    right = h.where(~F.col("__wrong")).orderBy("__h", *id_cols).limit(max(0, n - n_wrong))
    return picked_wrong.unionByName(right).drop("__h", "__wrong")


def sample_high_residual(df: DataFrame, actual: str, pred: str, id_cols: Sequence[str], n: int = 100,
                         seed: int = 42) -> DataFrame:
    """Up to n/4 rows with |residual| above its 90th percentile, the rest from the other rows,
    each by hash order (T7)."""
    r = df.withColumn("__ae", F.abs(F.col(actual).cast("double") - F.col(pred).cast("double"))) \
          .withColumn("__h", hash_fraction_expr(id_cols, seed))
    p90 = exact_quantiles(r, ["__ae"], (0.9,))[("__ae", 0.9)]
    hi = r.where(F.col("__ae") > p90).orderBy("__h", *id_cols).limit(n // 4)
    k = hi.count()
    lo = r.where(~(F.col("__ae") > p90)).orderBy("__h", *id_cols).limit(n - k)
    return hi.unionByName(lo).drop("__ae", "__h")


def sample_balanced(df: DataFrame, actual: str, pred: str, id_cols: Sequence[str], n: int = 100,
                    seed: int = 42) -> DataFrame:
    """Up to n/2 incorrect and the rest correct rows, by hash."""
    h = df.withColumn("__h", hash_fraction_expr(id_cols, seed)) \
          .withColumn("__wrong", F.col(actual).cast("string") != F.col(pred).cast("string"))
    wrong = h.where("__wrong").orderBy("__h", *id_cols).limit(n // 2)
    k = wrong.count()
    right = h.where(~F.col("__wrong")).orderBy("__h", *id_cols).limit(n - k)
    return wrong.unionByName(right).drop("__h", "__wrong")
