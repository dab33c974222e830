"""The pivot k-NN join, grid DBSCAN and components against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.operators import dbscan as DB
from tabforge.operators import knn as KN
from tabforge.operators.balance import smote
from tabforge.operators.components import components


def distances(X, Y, p=2):
    d = np.abs(X[:, None] - Y[None])
    return d.sum(-1) if p == 1 else np.sqrt((d * d).sum(-1))


def cloud(seed, n, d):
    """Groups, copies, a line of close rows and far single rows."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(c * 3, 0.3, (n // 5, d)) for c in range(3)]
    parts.append(np.repeat(rng.normal(0, 1, (1, d)), n // 5, 0))
    parts.append(np.linspace(0, 8, n - 4 * (n // 5))[:, None] * np.eye(d)[0] + 10)
    return np.round(np.vstack(parts), 3)


def frame(spark, X, ids=None, **more):
    rows = [(ids[i] if ids else i, [float(v) for v in x], *[m[i] for m in more.values()]) for i, x in enumerate(X)]
    kind = "string" if ids else "long"
    return spark.createDataFrame(rows, f"id {kind}, x array<double>" + "".join(f", {k} string" for k in more)).repartition(4)


@pytest.mark.parametrize("d,p,ids", [(2, 2, False), (6, 1, True)])
def test_knn_is_exact(spark, d, p, ids):
    X = cloud(d, 150, d)
    names = [f"r{(i * 37) % 1000:03d}" for i in range(len(X))] if ids else None
    df = frame(spark, X, names)
    key = np.array(names if ids else np.arange(len(X)))
    D = distances(X, X, p)
    for k, own, block in ((4, False, 20), (7, True, 4096)):
        got = KN.knn(df, df.withColumnRenamed("id", "rid"), k, "id", "rid", "x", exclude_self=own, block_rows=block, p=p, n_pivots=9).collect()
        by = {}
        for r in sorted(got, key=lambda r: r["rank"]):
            by.setdefault(r["id"], []).append((r["dist"], r["rid"]))
        for i in range(len(X)):
            want = sorted((float(D[i, j]), key[j].item()) for j in range(len(X)) if not (own and i == j))[:k]
            assert by[key[i].item()] == want


def test_knn_by_group_and_odd_rows(spark):
    X = cloud(3, 100, 3)
    group = ["a" if i % 3 else "b" for i in range(99)] + ["alone"]
    df = frame(spark, X, None, g=group).unionByName(spark.createDataFrame([(500, None, "a"), (501, [1.0, None, 0.0], "a")], "id long, x array<double>, g string"))
    got = KN.knn(df, df.withColumnRenamed("id", "rid"), 3, "id", "rid", "x", group="g", exclude_self=True, n_pivots=5).collect()
    D = distances(X, X)
    for i in range(100):
        want = sorted((float(D[i, j]), j) for j in range(100) if j != i and group[i] == group[j])[:3]
        assert sorted((r["dist"], r["rid"]) for r in got if r["id"] == i) == want
    assert {r["id"] for r in got} == set(range(99))
    assert KN.knn(df.limit(0), df.withColumnRenamed("id", "rid"), 3, "id", "rid", "x").collect() == []


def test_parts_are_pruned(spark):
    X = np.vstack([np.random.default_rng(1).normal(c * 100, 1, (100, 2)) for c in range(8)])
    df = frame(spark, X)
    asked = []
    plain = KN._search
    KN._search = lambda asks, *a: (asked.append(asks.count()), plain(asks, *a))[1]
    try:
        KN.knn(df, df.withColumnRenamed("id", "rid"), 3, "id", "rid", "x", n_pivots=28).collect()
    finally:
        KN._search = plain
    assert asked[0] == 800 and asked[1] < 800 * 28 / 4


def test_votes_by_distance(spark):
    train = spark.createDataFrame([(1, [0.0], 1), (2, [1.0], 0), (3, [1.1], 0), (4, [9.0], 1)], "id long, x array<double>, lab int")
    test = spark.createDataFrame([(10, [0.0], 0), (11, [0.1], 0), (12, [5.05], 0)], "id long, x array<double>, lab int")
    got = {w: {r["id"]: r["prediction"] for r in KN.knn_classify(train, test, 3, "id", "x", "lab", weights=w).collect()} for w in ("uniform", "distance")}
    assert got == {"uniform": {10: 0, 11: 0, 12: 0}, "distance": {10: 1, 11: 1, 12: 0}}


def brute_dbscan(X, ids, eps, ms):
    near = distances(X, X) <= eps
    core = near.sum(1) >= ms
    lab, number = np.full(len(X), -1), 0
    for i in sorted(np.flatnonzero(core), key=lambda i: ids[i]):
        if lab[i] < 0:
            todo, lab[i] = [i], number
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core & (lab < 0)):
                    lab[j] = number
                    todo.append(j)
            number += 1
    out = {}
    for i in range(len(X)):
        touched = lab[near[i] & core]
        out[ids[i]] = (int(lab[i]) if core[i] else int(touched.min()) if len(touched) else -1, bool(core[i]))
    return out


@pytest.mark.parametrize("d,ids,eps,ms", [(1, False, 0.05, 4), (2, True, 0.25, 5), (3, False, 0.5, 4), (5, True, 0.7, 4)])
def test_dbscan_is_exact(spark, d, ids, eps, ms):
    X = cloud(d + 10, 220, d)
    names = [f"k{(i * 91) % 997:03d}" for i in range(len(X))]
    df = frame(spark, X, names if ids else None)
    key = names if ids else list(range(len(X)))
    got = {r["id"]: (r["cluster"], r["core"]) for r in DB.dbscan(df, "id", "x", eps, ms, block_rows=30).collect()}
    assert got == brute_dbscan(X, key, eps, ms)


def test_dbscan_of_lattices_and_odd_tables(spark):
    # distances of exactly eps, cells linked by single rows, copies
    X = np.array([(i * 0.5, j * 0.5) for i in range(9) for j in range(6)] + [(20.0, 20.0)] * 12 + [(20.5, 20.0), (21.0, 20.0), (21.51, 20.0)])
    for eps, ms in ((0.5, 5), (0.5, 3)):
        got = {r["id"]: (r["cluster"], r["core"]) for r in DB.dbscan(frame(spark, X), "id", "x", eps, ms).collect()}
        assert got == brute_dbscan(X, list(range(len(X))), eps, ms)
    odd = frame(spark, X).unionByName(spark.createDataFrame([(900, None), (901, [1.0, float("nan")])], "id long, x array<double>"))
    got = {r["id"]: r["cluster"] for r in DB.dbscan(odd, "id", "x", 0.5, 3).collect()}
    assert got[900] == got[901] == -1 and len(got) == len(X) + 2
    assert DB.dbscan(frame(spark, X).limit(0), "id", "x", 0.5, 3).collect() == []


def test_spanning_keeps_components():
    rng = np.random.default_rng(4)
    for _ in range(50):
        near = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < 0.2
        (i, j), (c, e) = DB.spanning(near)
        at = {}
        def root(x):
            while at.setdefault(x, x) != x:
                x = at[x]
            return x
        for a, b in [(("r", x), ("c", y)) for x, y in zip(i, j)] + [(("c", x), ("c", y)) for x, y in zip(c, e)]:
            at[root(a)] = root(b)
        full = {}
        def full_root(x):
            while full.setdefault(x, x) != x:
                x = full[x]
            return x
        for x, y in zip(*np.nonzero(near)):
            full[full_root(("r", x))] = full_root(("c", y))
        nodes = [("r", x) for x in range(near.shape[0])] + [("c", x) for x in range(near.shape[1])]
        assert {frozenset(n for n in nodes if root(n) == root(m)) for m in nodes} == {frozenset(n for n in nodes if full_root(n) == full_root(m)) for m in nodes}
        assert len(i) + len(c) <= sum(near.shape)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 3), (300, 301), (301, 300)]
    for one_task in (0, 1000):
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), one_task=one_task).collect()}
        assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {300: 300, 301: 300}
    names = components(spark.createDataFrame([("b", "a"), ("c", "b"), ("z", "y")], "a string, b string"))
    assert {tuple(r) for r in names.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("y", "y"), ("z", "y")}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_smote_with_composite_ids(spark):
    from pyspark.ml.functions import array_to_vector
    rows = [(i % 4, i // 4, float(i % 7), float(i % 11), "big" if i < 360 else "small") for i in range(400)]
    df = spark.createDataFrame(rows, "a long, b long, f double, g double, label string")
    df = df.select("a", "b", "label", array_to_vector(F.array("f", "g")).alias("features"))
    got = smote(df, "label", "features", ["a", "b"], k=5)
    assert {(r["label"], r["synthetic"]): r["count"] for r in got.groupBy("label", "synthetic").count().collect()} == {
        ("big", False): 360, ("small", False): 40, ("small", True): 320}


def test_queries_are_sent_once_to_a_block(spark):
    """Many dimensions leave every part in reach: each query asks each block once, not each part."""
    rng = np.random.default_rng(3)
    X = rng.normal(0, 1, (600, 24))
    df = frame(spark, X)
    asked = []
    plain = KN._search
    KN._search = lambda asks, *a: (asked.append(asks.count()), plain(asks, *a))[1]
    try:
        got = KN.knn(df, df.withColumnRenamed("id", "rid"), 5, "id", "rid", "x", block_rows=200, n_pivots=60).collect()
    finally:
        KN._search = plain
    assert sum(asked) <= 600 * 6
    D = distances(X, X)
    for i in range(600):
        assert sorted((r["dist"], r["rid"]) for r in got if r["id"] == i) == sorted((float(D[i, j]), j) for j in range(600))[:5]


@pytest.mark.parametrize("p", [1, 2])
def test_nearest_in_block_far_from_the_origin(p):
    rng = np.random.default_rng(p)
    X = np.round(rng.normal(0, 1, (300, 3)), 2) + 1e6
    X[:80] = X[0]
    X[5], X[6, 1] = np.inf, np.nan
    key = np.arange(300) // 2
    with np.errstate(all="ignore"):
        D = distances(X, X, p)

    def own(i, j):
        return key[i] == key[j]
    own.most = 2
    for bound, of in ((np.full(300, np.inf), None), (np.full(300, 0.305), own)):
        i, j, d = KN.nearest_in_block(X, X, 4, p, bound, of)
        for q in range(300):
            want = sorted((D[q, c], c) for c in range(300) if np.isfinite(D[q, c]) and D[q, c] <= bound[q] and not (of and key[q] == key[c]))[:4]
            assert list(zip(d[i == q], j[i == q])) == want


def test_links_by_strips():
    """Blocks of many rows: counts, spanning forests and classes come some rows at a time, and only exact distances decide at the radius."""
    rng = np.random.default_rng(8)
    X = np.round(rng.normal(0, 1, (700, 2)), 1) + 1e5
    X[:50] = X[0]
    for eps in (0.0, 0.1, 0.5):
        near = distances(X, X) <= eps
        parts = list(KN.within(X, X, eps))
        assert len(parts) == 3 and (np.vstack([m for _, m in parts]) == near).all()
        (i, j), (c, e) = DB.forest(iter(parts), len(X))
        assert len(i) + len(c) <= 2 * len(X) and near[i].any(1).all()
        at = np.arange(2 * len(X))
        for a, b in [*zip(i, j + 700), *zip(c + 700, e + 700)]:
            at[at == at[a]] = at[b]
        full = np.arange(2 * len(X))
        for a, b in zip(*np.nonzero(near)):
            if full[a] != full[b + 700]:
                full[full == full[a]] = full[b + 700]
        assert len(set(at)) == len(set(full)) == len(set(zip(at, full)))
        names, met = DB.by_class(near, np.arange(700) % 3)
        assert all((met[:, k] == near[:, np.arange(700) % 3 == n].any(1)).all() for k, n in enumerate(names))
