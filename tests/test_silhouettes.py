"""Silhouettes of several labellings in one pass: exact ones, and those by cells within their bound."""

import numpy as np
import pytest

from tabforge.operators import silhouette as S
from tests.test_metrics import exact_silhouette


def table(spark, d, n=500, seed=1):
    rng = np.random.default_rng(seed)
    group = rng.integers(0, 6, n)
    x = rng.normal(0, 30, (6, d))[group] + rng.normal(0, 1, (n, d)) * np.array([0.1, 1, 1, 2, 3, 4])[group][:, None]
    x[:40] = x[0]                                   # copies, with equal and other labels
    rows = [(i, [float(v) for v in x[i]], int(group[i]), int(group[i] % 2), int(rng.integers(0, 3))) for i in range(n)]
    rows.append((n, [500.0] * d, 99, 0, 1))         # a singleton far away
    return spark.createDataFrame(rows, "id long, x array<double>, a int, b int, c int").repartition(4)


def got(df, **how):
    return {r["labelling"]: r["silhouette"] for r in S.silhouettes(df, "x", ["a", "b", "c"], **how).collect()}


@pytest.mark.parametrize("d", [1, 5])
def test_exact_in_blocks(spark, d):
    df = table(spark, d, 250)
    want = {c: exact_silhouette(df, "x", c) for c in "abc"}
    assert got(df, block=60) == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("d, tolerance", [(2, 1e-2), (3, 1e-1)])
def test_cells_stay_within_the_bound(spark, monkeypatch, d, tolerance):
    df = table(spark, d, 250)
    met = []
    plain = S._meet

    def watched(q, s, reach, radius, dims, n_labels, far, block):
        out = plain(q, s, reach, radius, dims, n_labels, far, block)
        met.append((far, out.count()))
        return out
    monkeypatch.setattr(S, "_meet", watched)
    want = {c: exact_silhouette(df, "x", c) for c in "abc"}
    mine = got(df, tolerance=tolerance, leaf_rows=4, block=300)
    assert dict(met)[True] > 0                       # some rows met cells
    assert all(abs(mine[c] - want[c]) <= 2 * tolerance for c in "abc")


def test_odd_tables(spark):
    df = spark.createDataFrame([([0.0, 0.0], "u", None), ([0.0, 0.0], "u", "p"), ([3.0, 4.0], "v", "q"), (None, "v", "q"), ([3.0, 4.0], "v", "p")],
                               "x array<double>, a string, b string")
    for tolerance in (0.0, 1e-2):
        r = {x["labelling"]: x["silhouette"] for x in S.silhouettes(df, "x", ["a", "b"], tolerance=tolerance).collect()}
        # of b's rows, p is one at either place: a is 5 to the own one, b is 5 or 0 to q
        assert r["a"] == 1.0 and r["b"] == pytest.approx((0.0 + 0.0 - 1.0) / 3)
    assert S.silhouettes(df.limit(0), "x", ["a"]).collect() == []
    same = spark.createDataFrame([([1.0], "u"), ([1.0], "v"), ([1.0], "u")], "x array<double>, a string")
    assert S.silhouettes(same, "x", ["a"], tolerance=0.1).first()["silhouette"] == 0.0


def test_label_sums_are_those_of_the_distances():
    """By strips and matrix products, with copies, far offsets, rows of no cluster, many clusters and values that aren't finite."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (600, 7)) + 1e4
    x[:100] = x[0]
    weight = rng.integers(1, 4, 600).astype(float)
    codes = [rng.integers(-1, 4, 600), np.arange(600) % 90, np.full(600, -1)]
    for odd in (False, True):
        if odd:
            x[7, 2] = np.nan
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) * weight
        for code, got_sums in zip(codes, S.label_sums(x, x, weight, codes)):
            want = np.array([d[:, code == c].sum(1) for c in range(code.max() + 1)]).reshape(-1, 600).T
            assert got_sums.shape == want.shape and np.allclose(got_sums, want, rtol=1e-9, atol=0, equal_nan=True)
