"""Metric definitions against brute-force Python on micro tables."""

import itertools

import pytest

from tabforge.operators import metrics as M

MINI_BINARY = [(1, 1, 0.9), (2, 0, 0.8), (3, 1, 0.8), (4, 1, 0.4), (5, 0, 0.3), (6, 0, 0.3), (7, 1, 0.3)]


def _auc(rows):
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def _ap(rows):
    npos = sum(y for _, y, _ in rows)
    out = 0.0
    for t in sorted({s for *_, s in rows}, reverse=True):
        sel = [y for _, y, s in rows if s >= t]
        step = sum(y for _, y, s in rows if s == t)
        out += step / npos * (sum(sel) / len(sel))
    return out


def test_auc_ap_with_ties(spark):
    df = spark.createDataFrame(MINI_BINARY, "id long, y int, s double")
    r = M.ranking_metrics(df, "y", "s", positive=1, buckets=3).first()
    assert r["roc_auc"] == pytest.approx(_auc(MINI_BINARY))
    assert r["average_precision"] == pytest.approx(_ap(MINI_BINARY))


def test_perfect_separation_and_mcc(spark):
    rows = [(i, int(i >= 5), float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, y int, s double")
    assert M.ranking_metrics(df, "y", "s", positive=1).first()["roc_auc"] == 1.0
    pred = df.selectExpr("y", "CAST(s >= 5 AS INT) AS p")
    assert M.binary_counts(pred, "y", "p").first()["mcc"] == pytest.approx(1.0)
    one = df.selectExpr("y", "1 AS p")                     # all one class predicted
    assert M.binary_counts(one, "y", "p").first()["mcc"] == 0.0


def test_multiclass_report(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")]       # class c never predicted
    df = spark.createDataFrame(rows, "actual string, pred string")
    rep = {r["label"]: r for r in M.class_report(df, "actual", "pred").collect()}
    assert rep["c"]["precision"] == 0.0 and rep["c"]["recall"] == 0.0
    assert rep["b"]["precision"] == pytest.approx(1 / 3)
    m = M.classification_metrics(df, "actual", "pred").first()
    assert m["accuracy"] == 0.5
    assert m["balanced_accuracy"] == pytest.approx((0.5 + 1 + 0) / 3)
    assert [r["label"] for r in M.never_predicted(df, "actual", "pred").collect()] == ["c"]


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "y double, p double")
    r = M.regression_metrics(df, "y", "p").first()
    assert r["mse"] == pytest.approx((0.25 + 0 + 1) / 3)
    assert r["r2"] == pytest.approx(1 - 1.25 / 2.0)


def exact_silhouette(df, features, label):
    """Euclidean silhouette by brute force."""
    import numpy as np
    pdf = df.select(features, label).toPandas()
    X, y = np.array(pdf[features].tolist(), dtype=float), pdf[label].to_numpy()
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    s = np.zeros(len(y))
    for i in range(len(y)):
        own = y == y[i]
        if own.sum() > 1:
            a = D[i, own].sum() / (own.sum() - 1)
            b = min(D[i, y == c].mean() for c in np.unique(y) if c != y[i])
            s[i] = (b - a) / max(a, b)
    return float(s.mean())


def plain_scores(X, y):
    """(k, n, Calinski-Harabasz, Davies-Bouldin, inertia, squared silhouette) by brute force."""
    import numpy as np
    X = X - X.mean(0)
    labels = np.unique(y)
    mu = np.array([X[y == c].mean(0) for c in labels])
    n = np.array([(y == c).sum() for c in labels])
    within = sum(((X[y == c] - m) ** 2).sum() for c, m in zip(labels, mu))
    between = (n * (mu ** 2).sum(1)).sum()
    spread = np.array([np.sqrt(((X[y == c] - m) ** 2).sum(1)).mean() for c, m in zip(labels, mu)])
    d = np.sqrt(((mu[:, None] - mu[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    db = ((spread[:, None] + spread[None]) / d).max(1).mean()
    D = ((X[:, None] - X[None]) ** 2).sum(-1)
    s = np.zeros(len(y))
    for i in range(len(y)):
        own = y == y[i]
        if own.sum() > 1:
            a = D[i, own].sum() / (own.sum() - 1)
            b = min(D[i, y == c].mean() for c in labels if c != y[i])
            s[i] = (b - a) / max(a, b)
    return len(labels), len(y), (between / (len(labels) - 1)) / (within / (len(y) - len(labels))), db, within, s.mean()


@pytest.mark.parametrize("k, shift", [(5, 0.0), (5, 1e8), (90, 1e8)])
def test_cluster_scores_match_brute_force(spark, k, shift):
    """Few and many clusters, near and far from the origin, by the sent table and by the k-NN join, in small blocks."""
    import numpy as np
    rng = np.random.default_rng(k)
    # steps of 1/1024 stay exact next to 1e8
    y = rng.integers(0, k, 400)
    X = np.round((rng.normal(0, 4, (k, 3))[y] + rng.normal(0, 1, (400, 3))) * 1024) / 1024
    X, y = np.vstack([X, [[60.0, 0.0, 0.0]]]), np.append(y, 777)
    df = spark.createDataFrame([([float(v + shift) for v in x], int(c)) for x, c in zip(X, y)] + [([0.0, 0.0, 0.0], -1), (None, 3), ([1.0, 1.0, 1.0], None)],
                               "x array<double>, c int")
    want = plain_scores(X, y)
    for sent in (1 << 20, 0):
        got = M.clustering_scores(df.repartition(3), "x", "c", block=7, sent=sent).first()
        assert tuple(got) == pytest.approx(want, rel=1e-9)


def test_cluster_scores_of_odd_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], -1), (1, [1.0, 2.0], 4), (2, [1.0, 3.0], 4)], "id long, x array<double>, c int")
    assert tuple(M.clustering_scores(df.limit(0), "x", "c").first()) == (0, 0, None, None, None, None)
    assert tuple(M.clustering_scores(df, "x", "c").first()) == (1, 2, None, None, None, None)
    same = spark.createDataFrame([([1.0], c) for c in "aabb"], "x array<double>, c string")
    got = M.clustering_scores(same, "x", "c", noise_label="-").first()
    assert got["davies_bouldin"] == float("inf") and got["silhouette_sq"] == 0.0


def test_silhouette_variants(spark):
    pts = [(i, [float(x), float(y)], c) for i, (x, y, c) in enumerate(
        [(0, 0, 0), (0, 1, 0), (1, 0, 0), (10, 10, 1), (10, 11, 1), (11, 10, 1), (5, 20, 2), (6, 20, 2)])]
    df = spark.createDataFrame(pts, "id long, x array<double>, c int")
    exact = exact_silhouette(df, "x", "c")
    assert 0.8 < exact < 1.0
    s = M.clustering_scores(df, "x", "c").first()
    assert s["n_clusters"] == 3 and s["calinski_harabasz"] > 10 and s["davies_bouldin"] < 0.5
    assert 0.9 < s["silhouette_sq"] <= 1.0


def test_blocked_euclidean_silhouette_matches_brute_force(spark):
    from tabforge.operators import neighbors as NB
    import numpy as np
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(c * 3, 1, 3)], int(c)) for i, c in enumerate(rng.integers(0, 3, 90))]
    rows.append((999, [50.0, 50.0, 50.0], 7))                     # a singleton cluster scores 0
    df = spark.createDataFrame(rows, "id long, x array<double>, c int")
    exact = exact_silhouette(df, "x", "c")
    got = NB.silhouette_euclidean(df, "id", "x", "c", block_rows=13).first()[0]
    assert got == pytest.approx(exact, rel=1e-9)
