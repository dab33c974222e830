"""Scores of a clustering for any number of clusters (E9-E12): Calinski-Harabasz, Davies-Bouldin, inertia and the
squared-Euclidean silhouette.

Clusters are a written table (count, centroid, spread, squares about the centroid), never a driver loop or one expression each.
Squares are summed about the centroids in a second pass instead of by the difference of two large sums, so data far
from the origin score like centred data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabforge.operators.knn import as_array, knn, matrix, nothing, pairwise
from tabforge.session import Written, ship_package

#: Numbers of a centroid table that goes to every task (8 MB); a larger one meets the rows in a k-NN join.
SENT = 1 << 20
#: Centroids compared at once.
BLOCK = 1024

SCORES = "n_clusters int, n long, calinski_harabasz double, davies_bouldin double, inertia double, silhouette_sq double"


def _points(df: DataFrame, features: str, label: str) -> tuple[DataFrame, int]:
    """(cl, x) of the rows that have both, moved so that one of them is the origin, and the number of dimensions."""
    rows = as_array(df, features).where(F.col("__x").isNotNull() & F.col(label).isNotNull()).select(
        F.col(label).alias("cl"), F.col("__x").alias("x"))
    one = rows.first()
    if one is None:
        return rows, 0
    origin = F.array(*[F.lit(v) for v in one["x"]])
    return rows.select("cl", F.zip_with("x", origin, lambda v, o: v - o).alias("x")), len(one["x"])


def _square(x, y):
    return F.aggregate(F.zip_with(x, y, lambda v, w: (v - w) * (v - w)), F.lit(0.0), lambda acc, v: acc + v)


def _clusters(rows: DataFrame, dims: int) -> Written:
    """(cl, n, mu, spread, within): count, centroid, mean distance and sum of squared distances to it."""
    centres = Written(rows.groupBy("cl").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col("x")[i]) for i in range(dims)]).alias("mu")))
    # the size of the written table decides whether it is broadcast; a hot cluster's rows are split elsewhere
    off = rows.join(centres.df, "cl").select("cl", _square("x", "mu").alias("d2")).groupBy("cl").agg(
        F.avg(F.sqrt("d2")).alias("spread"), F.sum("d2").alias("within"))
    out = Written(centres.df.join(off, "cl"))
    centres.drop()
    return out


def _davies_bouldin(clusters: DataFrame, k: int, block: int) -> float:
    """Mean over the clusters of the worst (spread + spread) / distance, by blocks of the table against each other."""
    import numpy as np
    import pandas as pd
    ship_package(clusters.sparkSession)
    n = -(-k // block)
    at = clusters.select("cl", "mu", "spread", F.pmod(F.xxhash64("cl"), F.lit(n)).cast("int").alias("own"))
    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = at.select("*", all_blocks.alias("other"))
    right = at.select(*[F.col(c).alias(c) for c in ("cl", "mu", "spread")], F.col("own").alias("other")).select("*", all_blocks.alias("own"))

    def worst(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if len(mine) == 0 or len(theirs) == 0:
            return nothing("cl", "worst")
        d = pairwise(matrix(mine["mu"]), matrix(theirs["mu"]))
        both = mine["spread"].to_numpy()[:, None] + theirs["spread"].to_numpy()[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 0, both / d, np.inf)
        ratio[mine["cl"].to_numpy()[:, None] == theirs["cl"].to_numpy()[None, :]] = 0.0
        return pd.DataFrame({"cl": mine["cl"].to_numpy(), "worst": ratio.max(1)})
    kind = clusters.schema["cl"].dataType.simpleString()
    got = left.groupBy("own", "other").cogroup(right.groupBy("own", "other")).applyInPandas(worst, f"cl {kind}, worst double")
    return got.groupBy("cl").agg(F.max("worst").alias("worst")).agg(F.avg("worst")).first()[0]


def _squared(rows: DataFrame, clusters: DataFrame, k: int, dims: int, sent: int) -> DataFrame:
    """One row: the mean of (b - a) / max(a, b) with a and b mean squared distances to the own and the nearest other cluster.

    The mean squared distance of x to a cluster is |x - mu|^2 + within / n, the squared distance from (x, 0) to (mu, sqrt(within / n)):
    the nearest other cluster is a nearest neighbour in one dimension more.
    """
    import numpy as np
    import pandas as pd
    ship_package(rows.sparkSession)
    lifted = clusters.select("cl", "n", F.concat("mu", F.array(F.sqrt(F.col("within") / F.col("n")))).alias("z"))
    if k * (dims + 1) <= sent:
        table = lifted.orderBy("cl").collect()
        shared = rows.sparkSession.sparkContext.broadcast(
            ([r["cl"] for r in table], np.array([r["n"] for r in table], dtype="float64"), np.array([r["z"] for r in table], dtype="float64")))

        def run(batches):
            names, size, z = shared.value
            place = {c: i for i, c in enumerate(names)}
            step = max(1, (1 << 22) // len(names))
            for pdf in batches:
                for i in range(0, len(pdf), step):
                    x = matrix(pdf["x"].iloc[i:i + step])
                    own = np.array([place[c] for c in pdf["cl"].iloc[i:i + step].tolist()])
                    d = pairwise(np.hstack([x, np.zeros((len(x), 1))]), z) ** 2
                    row = np.arange(len(x))
                    a = d[row, own] * size[own] / np.maximum(size[own] - 1, 1)
                    d[row, own] = np.inf
                    b = d.min(1)
                    top = np.maximum(a, b)
                    s = np.where((size[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0)
                    yield pd.DataFrame({"s": [s.sum()], "n": [len(s)]})
        return rows.mapInPandas(run, "s double, n long").agg((F.sum("s") / F.sum("n")).alias("silhouette_sq"))
    # written, so that a row has the same number in all uses
    numbered = Written(rows.select("cl", F.concat("x", F.array(F.lit(0.0))).alias("z"), F.monotonically_increasing_id().alias("row")))
    near = knn(numbered.df, lifted, 2, "row", "cl", "z").select("row", F.col("cl").alias("other"), "dist")
    own = numbered.df.join(lifted.withColumnRenamed("z", "mine"), "cl").select(
        "row", "cl", "n", (_square("z", "mine") * F.col("n") / F.greatest(F.col("n") - 1, F.lit(1))).alias("a"))
    b = own.join(near, "row").where("other <> cl").groupBy("row").agg(F.min(F.col("dist") * F.col("dist")).alias("b"), F.first("a").alias("a"), F.first("n").alias("n"))
    top = F.greatest("a", "b")
    return b.agg(F.avg(F.when((F.col("n") > 1) & (top > 0), (F.col("b") - F.col("a")) / top).otherwise(F.lit(0.0))).alias("silhouette_sq"))


def clustering_scores(df: DataFrame, features: str, label: str, noise_label: int = -1, block: int = BLOCK, sent: int = SENT) -> DataFrame:
    """One row (n_clusters, n, calinski_harabasz, davies_bouldin, inertia, silhouette_sq) over the rows that aren't noise.

    Scores are NULL for fewer than two clusters or as many clusters as rows; clusters of one centroid have an infinite
    Davies-Bouldin score; rows with a NULL label or vector are left out. ``block`` is the number of centroids compared at once and
    ``sent`` the numbers of a centroid table that goes to every task.
    """
    spark = df.sparkSession
    rows, dims = _points(df.where(F.col(label) != noise_label), features, label)
    if not dims:
        return spark.createDataFrame([(0, 0, None, None, None, None)], SCORES)
    clusters = _clusters(rows, dims)
    t = clusters.df.agg(F.count(F.lit(1)), F.sum("n"), F.sum("within"), *[F.sum(F.col("n") * F.col("mu")[i]) / F.sum("n") for i in range(dims)]).first()
    k, n, within, centre = t[0], t[1], t[2], F.array(*[F.lit(v) for v in t[3:]])
    if k < 2 or n <= k:
        clusters.drop()
        return spark.createDataFrame([(k, n, None, None, None, None)], SCORES)
    between = clusters.df.agg(F.sum(F.col("n") * _square("mu", centre))).first()[0]
    ch = (between / (k - 1)) / (within / (n - k)) if within > 0 else float("inf")
    db = _davies_bouldin(clusters.df, k, block)
    sil = _squared(rows, clusters.df, k, dims, sent).first()[0]
    clusters.drop()
    return spark.createDataFrame([(k, n, ch, db, within, sil)], SCORES)


def silhouette_squared(df: DataFrame, features: str, label: str, sent: int = SENT) -> DataFrame:
    """Mean silhouette with squared Euclidean distance, exact; NULL for fewer than two clusters."""
    rows, dims = _points(df, features, label)
    if not dims:
        return df.sparkSession.createDataFrame([(None,)], "silhouette_sq double")
    clusters = _clusters(rows, dims)
    k = clusters.df.count()
    if k < 2:
        return df.sparkSession.createDataFrame([(None,)], "silhouette_sq double")
    return _squared(rows, clusters.df, k, dims, sent)
