"""Clustering plan.

features (median imputation, population-std scaling, one-hot; array columns expanded)
-> PCA to ``n_components`` when there are more features -> k choice by vote of
silhouette / Calinski-Harabasz / Davies-Bouldin -> KMeans (best of n_init seeds),
Gaussian mixture, bisecting k-means (top-down stand-in for Ward), CF summaries +
weighted k-means (stand-in for Birch), DBSCAN -> scores -> best by silhouette.
"""

from __future__ import annotations

import statistics
import time
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from itertools import islice

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from tabforge.operators import metrics as M
from tabforge.operators import neighbors as NB
from tabforge.operators.knn import matrix
from tabforge.operators.silhouette import silhouettes
from tabforge.plans.prepare import fit_preparation
from tabforge.session import Written, ship_package, spread

CLUSTER_MODELS = ("kmeans", "hierarchical", "gaussian_mixture", "dbscan", "birch")


#: Largest error of a far distance, as a share of it, in the silhouettes of the plan; few rows are compared exactly.
TOLERANCE = 1e-4
#: How far centres of k-means move at most in a step that is the last one.
TOL = 1e-4
#: Rows that meet all centres at once.
ROWS = 4096


def silhouette_for(labelled: DataFrame, vec: str, label: str) -> float | None:
    """Euclidean silhouette over non-noise rows."""
    got = silhouettes(labelled.where(F.col(label) >= 0), vec, [label], TOLERANCE).first()
    return got["silhouette"] if got else None


@dataclass
class ClusterResult:
    leaderboard: DataFrame
    best_model: str | None
    labels: DataFrame
    k: int
    k_selection: DataFrame | None
    pca: DataFrame | None
    models: dict = field(default_factory=dict)
    extra: dict = field(default_factory=dict)

    def release(self) -> None:
        f = self.extra.get("features")
        if f is not None:
            f.unpersist()


def cluster_features(df: DataFrame, id_col: str, cols=None) -> tuple[DataFrame, list[str]]:
    """(id, features vector) with median imputation and population-std scaling (F6, F10);
    array<number> columns are expanded to one feature per element."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and f.name != id_col
              and (cols is None or f.name in cols)]
    base = df
    if arrays:
        dims = {a: df.select(F.max(F.size(a))).first()[0] for a in arrays}
        base = df.select("*", *[F.col(a)[i].cast("double").alias(f"{a}_{i}") for a in arrays for i in range(dims[a])]) \
                 .drop(*arrays)
    keep = [c for c in base.columns if c != id_col and (cols is None or c in cols or any(c.startswith(a + "_") for a in arrays))]
    base = base.select(id_col, *keep)
    cfg = {"preprocessing": {"missing_values": {"numeric_strategy": "median"},
                             "outlier_detection": {"strategy": "none"}},
           "feature_engineering": {"scaling": "standard"}}
    prep = fit_preparation(base, None, cfg, exclude=[id_col], problem="clustering")
    return prep.model.transform(base).select(id_col, "features"), prep.slot_names


def pca_reduce(feats: DataFrame, k: int, features_col: str = "features") -> tuple[DataFrame, DataFrame]:
    """PCA (F20) on the scaled (hence centred) features: returns (reduced rows, loadings table).
    Component signs are fixed so that the largest-magnitude loading is positive."""
    d = len(feats.select(features_col).first()[0])
    k = min(k, d, feats.count())                   # F21 dimension cap
    model = PCA(k=k, inputCol=features_col, outputCol="pca").fit(feats)
    comps = model.pc.toArray()                     # d x k
    ratio = model.explainedVariance.toArray()
    total_var = feats.select(vector_to_array(features_col).alias("a")).select(
        *[F.var_samp(F.col("a")[j]).alias(f"v{j}") for j in range(d)]).first()
    total = sum(v or 0.0 for v in total_var)
    signs = []
    for j in range(k):
        col = comps[:, j]
        signs.append(1.0 if col[abs(col).argmax()] >= 0 else -1.0)
    spark = feats.sparkSession
    rows = [(j, float(ratio[j]), float(sum(ratio[:j + 1])), [float(signs[j] * comps[i, j] * (ratio[j] * total) ** 0.5)
                                                             for i in range(d)]) for j in range(k)]
    load = spark.createDataFrame(rows, "component int, explained_variance_ratio double, cumulative_ratio double, "
                                       "loadings array<double>")
    red = model.transform(feats).withColumn("__p", vector_to_array("pca")).select(
        *[c for c in feats.columns if c != features_col],
        array_to_vector(F.array(*[F.col("__p")[j] * signs[j] for j in range(k)])).alias(features_col))
    return red, load


def _starts(feats, ways, seed, parallelism: int) -> list:
    """The centres that Spark's k-means|| begins with for each (k, number of the seed)."""
    def start(way):
        k, i = way
        return np.array(KMeans(k=k, seed=seed + i, maxIter=0, initMode="k-means||", tol=TOL).fit(feats).clusterCenters())
    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        return list(ex.map(start, ways))


def _matrices(feats):
    """The rows as matrices of at most ``ROWS`` rows, kept for many passes."""
    def pack(rows):
        rows = iter(rows)
        while some := list(islice(rows, ROWS)):
            yield np.array([r[0] for r in some])
    return feats.select(vector_to_array("features")).rdd.mapPartitions(pack).persist(StorageLevel.MEMORY_AND_DISK)


def _nearest(x, sets):
    """For each set of centres, the number of the centre nearest to each row of x and the squared distance, less the row's own square."""
    every = np.concatenate(sets)
    near = every @ x.T
    near *= -2
    near += (every * every).sum(1)[:, None]
    at = 0
    for c in sets:
        least, own = near[at], np.zeros(len(x), "int32")
        for j in range(1, len(c)):
            closer = near[at + j] < least
            own[closer] = j
            np.minimum(least, near[at + j], out=least)
        at += len(c)
        yield own, least


def _step(x, sets):
    """For each centre of all sets: the number and sum of its rows, and for the first of a set the squared distances of all rows."""
    out, square = [], (x * x).sum()
    for c, (own, least) in zip(sets, _nearest(x, sets)):
        got = np.zeros((len(c), x.shape[1] + 2))
        got[:, 0] = np.bincount(own, minlength=len(c))
        for j, v in enumerate(x.T):
            got[:, 1 + j] = np.bincount(own, v, len(c))
        got[0, -1] = least.sum() + square
        out.append(got)
    return np.concatenate(out)


def _lloyd(matrices, sets, max_iter: int) -> tuple[list, list]:
    """Lloyd's algorithm from many sets of centres at once: a step is one pass over the rows for all sets that still move. Returns the
    centres and, as Spark's ``trainingCost``, the squared distances to those before the last step."""
    sets, costs, moving = list(sets), [0.0] * len(sets), list(range(len(sets)))
    for _ in range(max_iter):
        if not moving:
            break
        now = [sets[i] for i in moving]
        sums = matrices.map(lambda x: _step(x, now)).treeReduce(np.add)
        still, at = [], 0
        for i, c in zip(moving, now):
            got = sums[at:at + len(c)]
            at += len(c)
            n = got[:, :1]
            sets[i] = np.where(n > 0, got[:, 1:-1] / np.maximum(n, 1), c)
            costs[i] = float(got[0, -1])
            if ((sets[i] - c) ** 2).sum(1).max() > TOL * TOL:
                still.append(i)
        moving = still
    return sets, costs


def _best_starts(feats, ks, n_init, seed, max_iter=300, parallelism: int = 8) -> dict:
    """k -> (number of the best of ``n_init`` seeds by training cost, the first on ties, its centres, its cost)."""
    ship_package(feats.sparkSession)
    ways = [(k, i) for k in ks for i in range(n_init)]
    starts = _starts(feats, ways, seed, parallelism)
    matrices = _matrices(feats)
    sets, costs = _lloyd(matrices, starts, max_iter)
    matrices.unpersist()
    best = {}
    for (k, i), c, cost in zip(ways, sets, costs):
        if k not in best or cost < best[k][2]:
            best[k] = (i, c, cost)
    return best


def _kmeans(feats, k, n_init, seed, max_iter=300, parallelism: int = 1):
    """Best of ``n_init`` seeded k-means|| runs by training cost (first seed wins ties)."""
    i = _best_starts(feats, [k], n_init, seed, max_iter, parallelism)[k][0] if n_init > 1 else 0
    return KMeans(k=k, seed=seed + i, maxIter=max_iter, initMode="k-means||", tol=TOL).fit(feats)


def _labelled(feats, sets: dict) -> DataFrame:
    """(x, a column of labels for each name of ``sets``): the nearest of its centres."""
    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                some = pdf.iloc[at:at + ROWS]
                labels = _nearest(matrix(some["x"]), list(sets.values()))
                yield some.assign(**{name: own for name, (own, _) in zip(sets, labels)})
    return feats.select(vector_to_array("features").alias("x")).mapInPandas(run, "x array<double>, " + ", ".join(f"{c} int" for c in sets))


def choose_k(feats: DataFrame, id_col: str, k_range=(2, 15), n_init: int = 10, seed: int = 42,
             parallelism: int = 8) -> tuple[int, DataFrame]:
    """k by vote of the best k for silhouette (max), Calinski-Harabasz (max) and
    Davies-Bouldin (min); a clear mode wins, ties go to int(median), none -> mid-range (H7)."""
    n = feats.count()
    ks = list(range(k_range[0], min(k_range[1], n - 1) + 1))
    if not ks:
        return k_range[0], feats.sparkSession.createDataFrame([], "k int, inertia double")

    best = _best_starts(feats, ks, n_init, seed, parallelism=parallelism)
    # the labels of every k beside the same rows, so that their distances are computed once
    lab = Written(_labelled(feats, {f"k{k}": best[k][1] for k in ks}))
    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        sils = ex.submit(lambda: {r["labelling"]: r["silhouette"] for r in silhouettes(lab.df, "x", [f"k{k}" for k in ks], TOLERANCE).collect()})
        scores = dict(zip(ks, ex.map(lambda k: M.clustering_scores(lab.df, "x", f"k{k}").first(), ks)))
        # fits that leave fewer than two clusters have no silhouette
        rows = [(k, best[k][2], sils.result()[f"k{k}"] if s["n_clusters"] >= 2 else None, s["calinski_harabasz"], s["davies_bouldin"])
                for k, s in scores.items()]
    lab.drop()
    table = feats.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double, "
                                                     "calinski_harabasz double, davies_bouldin double")
    votes = []
    for idx, better in ((2, max), (3, max), (4, min)):
        vals = [(r[idx], r[0]) for r in rows if r[idx] is not None]
        if vals:
            votes.append(better(vals, key=lambda v: v[0])[1])
    if not votes:
        return (ks[0] + ks[-1]) // 2, table
    cnt = Counter(votes).most_common()
    if len(cnt) == 1 or cnt[0][1] > cnt[1][1]:
        return cnt[0][0], table
    return int(statistics.median(votes)), table


def bisecting(feats: DataFrame, id_col: str, k: int, seed: int = 42, n_init: int = 3) -> DataFrame:
    """Top-down hierarchical clustering (stand-in for Ward): repeatedly split the cluster with
    the largest within-cluster sum of squares by a 2-means fit on that cluster's rows only.
    Labels are cut to the reliable checkpoint folder after every split."""
    from tabforge.session import cut_lineage
    lab = cut_lineage(feats.select(id_col, "features", F.lit(0).alias("cluster")))
    for step in range(1, k):
        x = vector_to_array("features")
        sse = (lab.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"),
                                           *[F.var_pop(x[j]).alias(f"v{j}") for j in range(len(lab.first()["features"]))])
               .collect())
        cand = [(sum(r[f"v{j}"] or 0.0 for j in range(len(r) - 2)) * r["n"], r["cluster"]) for r in sse if r["n"] >= 2]
        if not cand:
            break
        _, target = max(cand)
        part = lab.where(F.col("cluster") == target)
        m = _kmeans(part, 2, n_init, seed + step, parallelism=n_init)
        side = m.transform(part).select(id_col, F.col("prediction").alias("side"))
        lab = cut_lineage(lab.join(side, id_col, "left").select(
            id_col, "features", F.when(F.col("side") == 1, F.lit(step)).otherwise(F.col("cluster")).alias("cluster")))
    return lab.select(id_col, "cluster")


def cf_summaries(feats: DataFrame, id_col: str, cells_per_dim: int = 32) -> DataFrame:
    """Clustering-feature summaries (n, linear sum, square sum) per grid cell of the reduced
    space -- the Birch CF table, built with one grouped aggregate."""
    x = vector_to_array("features")
    d = len(feats.select("features").first()[0])
    stats = feats.select(x.alias("a")).select(*[F.min(F.col("a")[j]).alias(f"lo{j}") for j in range(d)],
                                              *[F.max(F.col("a")[j]).alias(f"hi{j}") for j in range(d)]).first()
    cell = F.concat_ws(":", *[F.least(F.floor((F.col("a")[j] - stats[f"lo{j}"]) /
                                              F.lit(((stats[f"hi{j}"] - stats[f"lo{j}"]) or 1.0) / cells_per_dim)),
                                      F.lit(cells_per_dim - 1)).cast("string") for j in range(d)])
    return feats.select(x.alias("a")).withColumn("cell", cell).groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(F.col("a")[j]) for j in range(d)]).alias("ls"),
        F.sum(F.aggregate("a", F.lit(0.0), lambda acc, v: acc + v * v)).alias("ss"))


def birch_like(feats: DataFrame, id_col: str, k: int, seed: int = 42):
    """Weighted k-means over CF centroids (weights = n), then nearest-centroid assignment."""
    cf = cf_summaries(feats, id_col)
    cent = cf.select(array_to_vector(F.transform("ls", lambda v: v / F.col("n"))).alias("features"),
                     F.col("n").cast("double").alias("w"))
    m = KMeans(k=min(k, cent.count()), seed=seed, weightCol="w", maxIter=300).fit(cent)
    return m


def _trained(name: str, feats: DataFrame, id_col: str, n: int, k: int, n_init: int, seed: int, parallelism: int) -> tuple:
    """(model, its (id, cluster) labels)."""
    if name == "kmeans":
        m = _kmeans(feats, k, n_init, seed, parallelism=parallelism)
        return m, m.transform(feats).select(id_col, F.col("prediction").alias("cluster"))
    if name == "hierarchical":
        return {"k": k}, bisecting(feats, id_col, k, seed)
    if name == "gaussian_mixture":
        with ThreadPoolExecutor(max_workers=parallelism) as ex:
            fits = list(ex.map(lambda i: GaussianMixture(k=k, seed=seed + i, maxIter=100).fit(feats),
                               range(n_init)))
        best = None
        for g in fits:                       # best log-likelihood, first seed on ties
            if best is None or g.summary.logLikelihood > best.summary.logLikelihood:
                best = g
        return best, best.transform(feats).select(id_col, F.col("prediction").alias("cluster"))
    if name == "birch":
        m = birch_like(feats, id_col, k, seed)
        return m, m.transform(feats).select(id_col, F.col("prediction").alias("cluster"))
    if name == "dbscan":
        eps = NB.estimate_eps(feats, id_col, "features", 20)
        ms = min(5, int(n * 0.05) + 1)
        return {"eps": eps, "min_samples": ms}, NB.dbscan(feats, id_col, "features", eps, ms).select(id_col, "cluster")
    raise ValueError(f"unknown clustering model {name!r}")


def _silhouettes_of(scored: dict, id_col: str) -> dict:
    """model -> its silhouette, of tables (id, cluster, x) with the same ids, none twice: the distances are computed once for all."""
    if not scored:
        return {}
    names = {name: f"m{i}" for i, name in enumerate(scored)}
    rows = reduce(DataFrame.unionByName, [df.where("cluster >= 0").select(F.col(id_col).alias("id"), "x", F.col("cluster").cast("long").alias("cluster"), F.lit(c).alias("of"))
                                          for c, df in zip(names.values(), scored.values())])
    beside = rows.groupBy("id").agg(F.first("x").alias("x"), *[F.max(F.when(F.col("of") == c, F.col("cluster"))).alias(c) for c in names.values()])
    got = {r["labelling"]: r["silhouette"] for r in silhouettes(beside, "x", list(names.values()), TOLERANCE).collect()}
    return {name: got.get(c) for name, c in names.items()}


def cluster(df: DataFrame, id_col: str, cols=None, n_clusters: int | None = None, k_range=(2, 15),
            n_components: int = 2, n_init: int = 10, models=CLUSTER_MODELS, seed: int = 42,
            parallelism: int = 8) -> ClusterResult:
    feats, slots = cluster_features(df, id_col, cols)
    load = None
    if len(slots) > n_components:
        feats, load = pca_reduce(feats, n_components)
    feats = spread(feats).persist(StorageLevel.MEMORY_AND_DISK)
    ksel = None
    if n_clusters is None:
        k, ksel = choose_k(feats, id_col, k_range, n_init, seed, parallelism)
    else:
        k = n_clusters
    n = feats.count()
    points = feats.select(id_col, vector_to_array("features").alias("x"))

    def train(name):
        """(seconds, model, labels, scores, sizes, the labelled points), or (seconds, error)."""
        t0 = time.time()
        try:
            m, lab = _trained(name, feats, id_col, n, k, n_init, seed, parallelism)
            scored = Written(lab.join(points, id_col))
            s = M.clustering_scores(scored.df, "x", "cluster").first()
            sizes = lab.agg(F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("k"),
                            F.sum(F.when(F.col("cluster") < 0, 1).otherwise(0)).alias("noise")).first()
            return time.time() - t0, m, lab, s, sizes, scored
        except Exception as e:  # noqa: BLE001 - failure isolation (H12)
            return time.time() - t0, e

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(models)))) as ex:
        done = dict(zip(models, ex.map(train, models)))
    fine = {name: d[5].df for name, d in done.items() if len(d) > 2 and d[3]["n_clusters"] >= 2}
    try:
        once = feats.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").limit(1).count() == 0
        sils = _silhouettes_of(fine, id_col) if once else {}
    except Exception:  # noqa: BLE001 - each model's own below
        sils = {}
    labels, rows, fitted = None, [], {}
    for order, name in enumerate(models):
        seconds, m, *rest = done[name]
        try:
            if not rest:
                raise m
            lab, s, sizes, scored = rest
            fitted[name] = m
            t0 = time.time()
            sil = sils[name] if name in sils else silhouette_for(fine[name], "x", "cluster") if name in fine else None
            rows.append((name, order, True, None, seconds + time.time() - t0, int(sizes["k"]), int(sizes["noise"] or 0),
                         sil, s["calinski_harabasz"], s["davies_bouldin"], s["inertia"]))
            lab = lab.withColumn("model", F.lit(name))
            labels = lab if labels is None else labels.unionByName(lab)
            scored.drop()
        except Exception as e:  # noqa: BLE001 - failure isolation (H12)
            rows.append((name, order, False, f"{type(e).__name__}: {e}", seconds, None, None, None, None,
                         None, None))
    spark = df.sparkSession
    board = spark.createDataFrame(rows, "model string, model_order int, trained_successfully boolean, error string, "
                                        "train_seconds double, n_clusters int, n_noise int, silhouette double, "
                                        "calinski_harabasz double, davies_bouldin double, inertia double")
    best = select_best_clustering(board, k)
    return ClusterResult(board, best, labels, k, ksel, load, fitted, {"features": feats})


def select_best_clustering(board: DataFrame, target_k: int) -> str | None:
    """H5: highest silhouette; else the cluster count nearest the target k; else the first."""
    ok = board.where("trained_successfully")
    r = ok.where(F.col("silhouette").isNotNull()).orderBy(F.col("silhouette").desc(), "model_order").first()
    if r:
        return r["model"]
    r = ok.where(F.col("n_clusters").isNotNull()).orderBy(F.abs(F.col("n_clusters") - target_k), "model_order").first()
    if r:
        return r["model"]
    r = ok.orderBy("model_order").first()
    return r["model"] if r else None
