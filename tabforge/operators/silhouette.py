"""Euclidean silhouettes of several labellings of the same rows in one pass.

Distances between rows don't depend on the labels, so they are computed once for all labellings. In up to three dimensions far rows
are met as cells of a hierarchical grid: the sum of the distances from x to the rows of a cell and label pattern is
n r + (tr M - u'Mu) / 2r, with r and u the distance and direction from x to their centroid and M their second moments. By
Taylor's theorem the rest is at most ``REST`` diag^3 / gap^2 a row, with diag the cell's diagonal and gap its distance from the cell of x, so
a cell counts as far where that is at most ``tolerance`` times the gap. Two rows meet at the coarsest level at which their cells are
far, or one by one where they are near at the finest, so each pair counts once. Tasks compare a tile of cells with the
cells around it, in blocks of bounded size, and give sums by row and cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tabforge.operators.knn import BLOCK_ROWS, as_array, distances, matrix, nothing, strips
from tabforge.session import Written, ship_package

#: Fixed value: the largest third derivative of the distance along a line, 2 / sqrt(3), over 3!.
REST = 2 / math.sqrt(3) / 6
#: Levels of the grid at most, and cells of a tile's edge as a power of two.
LEVELS, TILE = 20, 3
BLOCK = 2048
#: A squared distance by matrix product counts where its rounding is at most this share of it, else the rows' own distance does.
SHARE = 1e-9


def label_sums(X, S, n, codes):
    """For each of ``codes``, which number the clusters of the rows of S from 0 (-1: none), the sums of the distances from the rows of X to the
    clusters' rows, counted ``n`` times; a strip of distances at a time."""
    import numpy as np
    ways, out = [], [[] for _ in codes]
    for code in codes:
        use = np.flatnonzero(code >= 0)
        order = use[np.argsort(code[use], kind="stable")]
        names = int(code.max(initial=-1)) + 1
        share = None
        if 0 < names <= 64:
            share = np.zeros((len(S), names))
            share[use, code[use]] = n[use]
        ways.append((order, np.searchsorted(code[order], np.arange(names)), share))
    for at, near, slack in strips(X, S):
        with np.errstate(all="ignore"):
            i, j = np.nonzero(~(near * SHARE >= slack[:, None]))
            near = np.sqrt(near, out=near)
            near[i, j] = distances(X, S, i + at, j)
            # a product with zeros would spread what isn't finite to all clusters
            fine = np.isfinite(near.sum())
            for (order, first, share), sums in zip(ways, out):
                if share is not None and fine:
                    sums.append(near @ share)
                else:
                    sums.append(np.add.reduceat(near[:, order] * n[order], first, axis=1) if len(first) else np.zeros((len(near), 0)))
    return [np.concatenate(s) for s in out]


def _sums(radius: float, n_cells: int, n_labels: int, far: bool):
    """Sums of the distances from a block of queries to a block of sources, by label."""
    import json

    import numpy as np
    import pandas as pd
    cells = [f"c{i}" for i in range(n_cells)]

    def far_apart(a, b):
        square = 0
        for x, y in zip(a, b.T):
            gap = np.maximum(np.abs(x - y) - 1, 0)
            square = square + gap * gap
        return square >= radius * radius

    def spans(X, S, n, M):
        """The summed distances from the rows of X to the rows of each source."""
        diff = [x[:, None] - y[None, :] for x, y in zip(X.T, S.T)]
        square = sum(v * v for v in diff)
        r = np.sqrt(square)
        if M is None:
            return r * n
        across = sum(M[:, i, i] for i in range(len(diff)))[None, :] - sum(
            (1 if i == j else 2) * diff[i] * diff[j] * M[:, i, j] for i in range(len(diff)) for j in range(i, len(diff))) / square
        return r * n + across / (2 * r)

    def run(q, s):
        if len(q) == 0 or len(s) == 0:
            return nothing("row", "lab", "cl", "s")
        code, kinds = pd.factorize(s["labs"])
        # the label of each kind of source, by labelling
        kinds = np.array([json.loads(v) for v in kinds], dtype=object).reshape(len(kinds), n_labels)
        row = q["row"].to_numpy()
        if not n_cells:
            X, S, n = matrix(q["x"]), matrix(s["x"]), s["n"].to_numpy().astype(float)
            labels = [pd.factorize(kinds[code, j], sort=True) for j in range(n_labels)]
            all_sums = label_sums(X, S, n, [own for own, _ in labels])
            return pd.concat([pd.DataFrame({"row": np.repeat(row, len(names)), "lab": j, "cl": np.tile(np.asarray(names, dtype=object), len(row)),
                                            "s": sums.ravel()}) for j, ((_, names), sums) in enumerate(zip(labels, all_sums))], ignore_index=True)
        by = np.argsort(code, kind="stable")
        s, code = s.iloc[by], code[by]
        X, S, n = matrix(q["x"]), matrix(s["x"]), s["n"].to_numpy().astype(float)
        QC, SC = q[cells].to_numpy(), s[cells].to_numpy()
        M = matrix(s["m"]).reshape(len(S), X.shape[1], X.shape[1]) if far else None
        # by kind of source first: there are few of them around a place
        D, met = np.zeros((len(X), len(kinds))), np.zeros((len(X), len(kinds)), bool)
        for at in pd.Series(np.arange(len(X))).groupby([QC[:, i] for i in range(n_cells)]).indices.values():
            apart = far_apart(QC[at[0]], SC)
            other = np.flatnonzero(apart & ~far_apart(QC[at[0]] >> 1, SC >> 1) if far else ~apart)
            if not len(other):
                continue
            first = np.flatnonzero(np.diff(code[other], prepend=-1))
            kind = code[other[first]]
            near, size, moments = S[other], n[other], M[other] if far else None
            for i in range(0, len(at), 64):
                some = at[i:i + 64]
                D[np.ix_(some, kind)] = np.add.reduceat(spans(X[some], near, size, moments), first, axis=1)
            met[np.ix_(at, kind)] = True
        out = []
        for j in range(n_labels):
            own, names = pd.factorize(kinds[:, j], sort=True)
            use = np.flatnonzero(own >= 0)
            if not len(use):
                continue
            order = use[np.argsort(own[use], kind="stable")]
            first = np.searchsorted(own[order], np.arange(len(names)))
            total = np.add.reduceat(D[:, order], first, axis=1)
            a, b = np.nonzero(np.logical_or.reduceat(met[:, order], first, axis=1))
            out.append(pd.DataFrame({"row": row[a], "lab": j, "cl": np.asarray(names, dtype=object)[b], "s": total[a, b]}))
        return pd.concat(out, ignore_index=True) if out else nothing("row", "lab", "cl", "s")
    return run


def _meet(queries: DataFrame, sources: DataFrame, reach: int, radius: float, dims: int, n_labels: int, far: bool, block: int) -> DataFrame:
    """(row, lab, cl, s): queries (lev, c, row, x) with the sources (lev, c, x, n, labs) of the tiles around them."""
    cells, tiles = [f"c{i}" for i in range(dims)], [f"t{i}" for i in range(dims)]
    # named anew: both come from one table
    queries, sources = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (queries, sources))
    q = queries.select("*", *[F.shiftright(c, TILE).alias(t) for c, t in zip(cells, tiles)])
    s = sources
    for c, t in zip(cells, tiles):
        s = s.withColumn(t, F.explode(F.sequence(F.shiftright(F.col(c) - reach, TILE), F.shiftright(F.col(c) + reach, TILE))))
    key = ["lev", *tiles]

    def blocks(df, name):
        return df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    tasks = Written(blocks(q, "nq").join(blocks(s, "ns"), key)).df

    key = [*key, "bq", "bs"]
    left = q.join(tasks, key[:-2]).select(*q.columns, F.pmod(F.xxhash64("row"), F.col("nq")).cast("int").alias("bq"),
                                          F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("bs"))
    right = s.join(tasks, key[:-2]).select(*s.columns, F.pmod(F.xxhash64("x", "labs"), F.col("ns")).cast("int").alias("bs"),
                                           F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("bq"))
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_sums(radius, dims, n_labels, far), "row long, lab int, cl string, s double")


def _finest(points: DataFrame, place, leaf_rows: int, dims: int) -> int:
    """The coarsest level at which a row shares its cell with at most ``leaf_rows`` rows on average, so a dense place makes it finer."""
    cells = [f"c{i}" for i in range(dims)]
    most = Written(points.select(*place(LEVELS)).groupBy(*cells).agg(F.count(F.lit(1)).alias("n")))
    each = most.df.withColumn("lev", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).select(
        "lev", "n", *[F.expr(f"shiftright({c}, {LEVELS} - lev)").alias(c) for c in cells])
    full = each.groupBy("lev", *cells).agg(F.sum("n").alias("n")).groupBy("lev").agg(
        (F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")).alias("rows")).orderBy("lev").collect()
    most.drop()
    return next((r["lev"] for r in full if r["rows"] <= leaf_rows), LEVELS)


def silhouettes(df: DataFrame, vec: str, labels: list[str], tolerance: float = 0.0, leaf_rows: int = 16, block: int | None = None) -> DataFrame:
    """(labelling, silhouette): the mean Euclidean silhouette of each label column.

    With ``tolerance`` 0, or in more than three dimensions, all distances are exact; else each distance's error is at most
    ``tolerance`` of it, so a silhouette is at most about twice that away. A row whose label is NULL belongs to no
    cluster of that labelling; rows without a vector are left out; singletons score 0; a labelling without rows is not in the result. Rows with equal
    vectors and labels are compared once. Rows that a grid of ``LEVELS`` levels can't part are compared block by block.
    """
    ship_package(df.sparkSession)
    rows = as_array(df, vec).where(F.col("__x").isNotNull())
    points = Written(rows.select(F.col("__x").alias("x"), F.to_json(F.array(*[F.col(c).cast("string") for c in labels])).alias("labs"))
                     .groupBy("x", "labs").agg(F.count(F.lit(1)).alias("n")).withColumn("row", F.monotonically_increasing_id())).df
    one = points.select(F.size("x").alias("d")).first()
    d = one["d"] if one else 0
    dims, levels, radius = 0, [], 0.0
    if 0 < d <= 3 and tolerance > 0:
        box = points.agg(*[F.min(F.col("x")[i]) for i in range(d)], *[F.max(F.col("x")[i]) for i in range(d)]).first()
        low, width = box[:d], max(h - l for l, h in zip(box[:d], box[d:]))

        def place(level):
            number = F.lit(level) if isinstance(level, int) else level
            share = [(F.col("x")[i] - F.lit(low[i])) / F.lit(width) for i in range(d)]
            fine = [F.least(F.floor(v * (1 << LEVELS)), F.lit((1 << LEVELS) - 1)).cast("int") for v in share]
            return [F.call_function("shiftright", v, F.lit(LEVELS) - number).alias(f"c{i}") for i, v in enumerate(fine)]
        if width > 0:
            radius = math.sqrt(d) * (REST / tolerance) ** (1 / 3)
            finest = _finest(points, place, leaf_rows, d)
            # no cells are far apart on coarser levels
            levels = list(range(max(1, math.floor(math.log2(radius + 1))), finest + 1))
    block = block or (BLOCK if levels else BLOCK_ROWS)
    if not levels:
        whole = points.select(F.lit(0).alias("lev"), "x", "labs", "n", "row")
        parts = _meet(whole.select("lev", "row", "x"), whole.select("lev", "x", "labs", "n"), 0, 0.0, 0, len(labels), False, block)
    else:
        dims, reach, finest = d, 1 + math.floor(radius), levels[-1]
        cells = [f"c{i}" for i in range(d)]
        leaf = points.select(F.lit(finest).alias("lev"), "x", "labs", "n", "row", *place(finest))
        parts = _meet(leaf.select("lev", *cells, "row", "x"), leaf.select("lev", *cells, "x", "labs", "n"), reach, radius, dims, len(labels), False, block)
        each = points.withColumn("lev", F.explode(F.array(*map(F.lit, levels)))).select("lev", "x", "labs", "n", "row", *place(F.col("lev")))
        # moments about the middle of the cell, then about the centroid
        edge = F.lit(width) / F.pow(F.lit(2.0), "lev")
        off = [F.col("x")[i] - (F.lit(low[i]) + (F.col(f"c{i}") + 0.5) * edge) for i in range(d)]
        n = F.col("n")
        sums = each.groupBy("lev", *cells, "labs").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(n * o) for o in off]).alias("a"), F.array(*[F.sum(n * o * p) for o in off for p in off]).alias("b"))
        far = sums.select(
            "lev", *cells, "labs", "n",
            F.array(*[F.lit(low[i]) + (F.col(f"c{i}") + 0.5) * edge + F.col("a")[i] / n for i in range(d)]).alias("x"),
            F.array(*[F.col("b")[i * d + j] - F.col("a")[i] * F.col("a")[j] / n for i in range(d) for j in range(d)]).alias("m"))
        parts = parts.unionByName(_meet(each.select("lev", *cells, "row", "x"), Written(far).df, 2 * reach + 1, radius, dims, len(labels), True, block))
    own = points.select("row", "n", F.posexplode(F.from_json("labs", "array<string>")).alias("lab", "own")).where("own is not null")
    sizes = Written(own.groupBy("lab", F.col("own").alias("cl")).agg(F.sum("n").alias("size"))).df
    sums = parts.groupBy("row", "lab", "cl").agg(F.sum("s").alias("s"))
    both = sums.join(sizes, ["lab", "cl"]).join(own, ["row", "lab"])
    mine = F.col("cl") == F.col("own")
    of_row = both.groupBy("row", "lab").agg(
        F.first("n").alias("n"), F.max(F.when(mine, F.col("size"))).alias("size"),
        F.max(F.when(mine, F.col("s") / F.greatest(F.col("size") - 1, F.lit(1)))).alias("a"), F.min(F.when(~mine, F.col("s") / F.col("size"))).alias("b"))
    top = F.greatest("a", "b")
    score = F.when((F.col("size") > 1) & F.col("b").isNotNull() & (top > 0), (F.col("b") - F.col("a")) / top).otherwise(F.lit(0.0))
    named = F.element_at(F.array(*map(F.lit, labels)), F.col("lab") + 1)
    return of_row.groupBy("lab").agg((F.sum(score * F.col("n")) / F.sum("n")).alias("silhouette")).select(named.alias("labelling"), "silhouette")
