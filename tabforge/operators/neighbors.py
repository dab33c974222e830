"""Neighbour operators (J3-J6, M12, M20, E9): the k-NN join is in ``knn``, DBSCAN and range counts in ``dbscan``; here is
the silhouette, by blocked nested loops.

Rows are hashed into query blocks and reference blocks of at most ``block_rows`` rows.
Each (query block, reference block) pair is one cogrouped task that computes distances
in numpy and emits only per-query partial results -- the k nearest candidates, or a
neighbour count, or the smallest neighbour label -- never the pairs themselves. The
partials are then reduced per query row with small bounded groups (k x blocks rows).

Exact neighbour search has O(n_query x n_ref) work; ``max_pairs`` makes that bound an
explicit error instead of a silent cap or an approximate answer.
"""

from __future__ import annotations

import math
from pyspark.sql import DataFrame, functions as F

from tabforge.operators.dbscan import dbscan, range_counts  # noqa: F401 - part of this module's interface
from tabforge.operators.knn import (BLOCK_ROWS, KNNClassifier, as_array, estimate_eps, knn, knn_classify, matrix,  # noqa: F401
                                    pairwise)
from tabforge.operators.silhouette import label_sums
from tabforge.session import ship_package

#: No bound by default; a caller may set one to fail early.
MAX_PAIRS = None


def _blocks(n: int, block_rows: int) -> int:
    return max(1, math.ceil(n / block_rows))


def _prepare(query: DataFrame, ref: DataFrame, qid: str, rid: str, vec: str, group: str | None,
             block_rows: int, max_pairs: float | None):
    ship_package(query.sparkSession)
    nq, nr = query.count(), ref.count()
    if max_pairs is not None and nq * nr > max_pairs:
        raise ValueError(f"exact neighbour search needs {nq} x {nr} distance evaluations (> {max_pairs:g}); "
                         "reduce the inputs or raise max_pairs explicitly")
    bq, br = _blocks(nq, block_rows), _blocks(nr, block_rows)
    g = [F.col(group).cast("string").alias("__g")] if group else [F.lit("").alias("__g")]
    q = as_array(query, vec).select(F.col(qid).alias("qid"), "__x", *g,
                                     (F.abs(F.xxhash64(F.col(qid))) % bq).alias("qb"))
    r = as_array(ref, vec).select(F.col(rid).alias("rid"), "__x", *g,
                                   (F.abs(F.xxhash64(F.col(rid))) % br).alias("rb"))
    qx = q.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(br - 1)).cast("array<long>")))
    rx = r.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(bq - 1)).cast("array<long>")))
    return qx, rx


def silhouette_euclidean(df: DataFrame, id_col: str, vec: str, label: str, block_rows: int = BLOCK_ROWS,
                         max_pairs: float | None = MAX_PAIRS) -> DataFrame:
    """Mean silhouette with plain Euclidean distance, exact.

    Each (query block, reference block) task sums the distances from every query row to the
    reference rows of each cluster and emits (row, cluster, sum, count) -- never the pairs;
    a grouped sum completes the per-cluster means, then a(i) (own cluster, self excluded),
    b(i) (nearest other cluster) and s(i) = (b - a) / max(a, b), 0 for singletons.
    O(n^2) distance work, bounded by ``max_pairs``."""
    import numpy as np
    import pandas as pd
    qx, rx = _prepare(df, df, id_col, id_col, vec, label, block_rows, max_pairs)

    def local(qpdf, rpdf):
        if len(qpdf) == 0 or len(rpdf) == 0:
            return pd.DataFrame({"qid": [], "own": [], "cl": [], "s": [], "n": []})
        code, names = pd.factorize(rpdf["__g"])
        sums, = label_sums(matrix(qpdf["__x"]), matrix(rpdf["__x"]), np.ones(len(rpdf)), [code])
        return pd.DataFrame({"qid": np.repeat(qpdf["qid"].to_numpy(), len(names)), "own": np.repeat(qpdf["__g"].to_numpy(), len(names)),
                             "cl": np.tile(np.asarray(names, dtype=object), len(qpdf)), "s": sums.ravel(),
                             "n": np.tile(np.bincount(code[code >= 0], minlength=len(names)), len(qpdf))})

    schema = f"qid {df.schema[id_col].dataType.simpleString()}, own string, cl string, s double, n long"
    part = qx.groupBy("qb", "rb").cogroup(rx.groupBy("qb", "rb")).applyInPandas(local, schema)
    per = part.groupBy("qid", "own", "cl").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = F.col("cl") == F.col("own")
    pts = per.groupBy("qid").agg(
        F.max(F.when(own, F.col("s") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"),
        F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"),
        F.max(F.when(own, F.col("n"))).alias("own_n"))
    s = F.when((F.col("own_n") > 1) & F.col("b").isNotNull(), (F.col("b") - F.col("a")) / F.greatest("a", "b")) \
         .otherwise(F.lit(0.0))
    return pts.agg(F.avg(s).alias("silhouette"))
