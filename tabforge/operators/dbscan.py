"""DBSCAN and range counts on an epsilon grid.

Up to three dimensions, cells have side eps / sqrt(d), so rows of one cell are within eps of each other: a cell of ``min_samples`` rows
has only core rows, and all core rows of a cell are in one cluster. Only rows of sparser cells are compared with rows, those of the
cells around them, which makes a number of comparisons linear in the rows. Cells, not rows, are linked and
merged: two cells by the boxes of their core rows where these decide, else by single rows against the other's box, and by
pairs only of rows that this leaves open.

With more dimensions cells have side eps in the three dimensions of largest variance, rows meet those of the 27 cells around them in
blocks of bounded size, by matrix products whose rounding is bounded and exact distances where it matters, some rows at a time, and a task
keeps a spanning forest of the links it finds, never all of them.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, functions as F

from tabforge.operators.components import components
from tabforge.operators.knn import BLOCK_ROWS, as_array, matrix, nothing, within
from tabforge.session import Written, ship_package

#: Dimensions of the grid.
GRID_DIMS = 3


def _points(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, __x): rows whose vector has no NULL or NaN."""
    p = as_array(df.select(F.col(id_col).alias("id"), vec), vec).select("id", "__x")
    return p.where(F.col("__x").isNotNull() & ~F.exists("__x", lambda v: v.isNull() | F.isnan(v)))


def _dimensions(points: DataFrame) -> int:
    first = points.select(F.size("__x").alias("d")).first()
    return first["d"] if first else 0


def _cell(names) -> F.Column:
    return F.concat_ws(",", *[c if isinstance(c, F.Column) else F.col(c) for c in names])


# ------------------------------------------------------------------ up to three dimensions: cells of rows near each other

def _around(d: int, half: bool = False) -> list[tuple[int, ...]]:
    """Offsets of the cells that may hold rows within eps of a cell's rows, with ``half`` one of each two opposite ones."""
    out = [o for o in itertools.product(range(-2, 3), repeat=d) if sum(max(abs(x) - 1, 0) ** 2 for x in o) <= d]
    return [o for o in out if o > (0,) * d] if half else out


def _with_neighbours(df: DataFrame, d: int, half: bool = False) -> DataFrame:
    """Each row once for each neighbouring cell ``to``."""
    steps = F.array(*[F.struct(*[F.lit(v).cast("long").alias(f"o{j}") for j, v in enumerate(o)]) for o in _around(d, half)])
    return df.withColumn("o", F.explode(steps)).withColumn("to", _cell([F.col(f"c{j}") + F.col(f"o.o{j}") for j in range(d)])).drop("o")


def _distance(d: int, a: str, b: str) -> F.Column:
    return F.sqrt(sum(((F.col(f"{a}{j}") - F.col(f"{b}{j}")) * (F.col(f"{a}{j}") - F.col(f"{b}{j}")) for j in range(1, d)),
                      (F.col(f"{a}0") - F.col(f"{b}0")) * (F.col(f"{a}0") - F.col(f"{b}0"))))


def _box_distances(d: int, lo: str, hi: str, lo2: str, hi2: str) -> tuple[F.Column, F.Column]:
    """The least and greatest distance of points of two boxes; rounding goes the way it does for points."""
    near = far = F.lit(0.0)
    for j in range(d):
        gap = F.greatest(F.col(f"{lo}{j}") - F.col(f"{hi2}{j}"), F.col(f"{lo2}{j}") - F.col(f"{hi}{j}"), F.lit(0.0))
        span = F.greatest(F.abs(F.col(f"{hi}{j}") - F.col(f"{lo2}{j}")), F.abs(F.col(f"{hi2}{j}") - F.col(f"{lo}{j}")))
        near, far = near + gap * gap, far + span * span
    return F.sqrt(near), F.sqrt(far)


def _cell_dbscan(points: DataFrame, d: int, eps: float, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """(id, raw) of core rows, raw naming their cluster, and (id, raw) links of other rows to clusters of core rows near them."""
    # a little less, so that rounding puts no two rows of a cell further apart than eps
    side = eps / math.sqrt(d) * (1 - 1e-9)
    xs = [F.col("__x")[j].alias(f"x{j}") for j in range(d)]
    rows = points.select("id", *xs).select("*", *[F.floor(F.col(f"x{j}") / side).alias(f"c{j}") for j in range(d)])
    cs, vs = [f"c{j}" for j in range(d)], [f"x{j}" for j in range(d)]
    p = Written(rows.withColumn("cell", _cell(cs)))
    counts = Written(p.df.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
    counted = p.df.join(counts.df, "cell")
    sparse = Written(counted.where(F.col("n") < min_samples).drop("n"))
    asked = _with_neighbours(sparse.df, d).select(F.col("id").alias("qid"), "to", *[F.col(f"x{j}").alias(f"q{j}") for j in range(d)])
    near = asked.join(p.df.select(F.col("cell").alias("to"), *vs), "to").where(_distance(d, "q", "x") <= eps)
    n_near = near.groupBy("qid").agg(F.count(F.lit(1)).alias("m")).select(F.col("qid").alias("id"), "m")
    judged = Written(sparse.df.join(n_near, "id", "left").withColumn("core", F.coalesce(F.col("m"), F.lit(0)) >= min_samples).drop("m"))
    core = Written(counted.where(F.col("n") >= min_samples).drop("n").unionByName(judged.df.where("core").drop("core")))
    boxes = Written(core.df.groupBy("cell", *cs).agg(*[F.min(v).alias(f"lo{j}") for j, v in enumerate(vs)], *[F.max(v).alias(f"hi{j}") for j, v in enumerate(vs)]))

    other = boxes.df.select(F.col("cell").alias("to"), *[F.col(f"{s}{j}").alias(f"{s}_to{j}") for s in ("lo", "hi") for j in range(d)])
    least, most = _box_distances(d, "lo", "hi", "lo_to", "hi_to")
    pairs = Written(_with_neighbours(boxes.df, d, half=True).join(other, "to").withColumn("far", most).where(least <= eps))
    sure = pairs.df.where(F.col("far") <= eps).select(F.col("cell").alias("a"), F.col("to").alias("b"))
    unsure = pairs.df.where(F.col("far") > eps)

    def against(box_of: str, cell_of: str, lo: str, hi: str) -> DataFrame:
        """Core rows of one side that the box of the other leaves near."""
        tests = unsure.select(F.col("cell").alias("a"), F.col("to").alias("b"), F.col(cell_of).alias("at"),
                              *[F.col(f"{lo}{j}").alias(f"l{j}") for j in range(d)], *[F.col(f"{hi}{j}").alias(f"h{j}") for j in range(d)])
        met = core.df.select(F.col("cell").alias("at"), *vs).join(tests, "at")
        near_, far_ = _box_distances(d, "x", "x", "l", "h")
        return met.withColumn("far", far_).where(near_ <= eps).select("a", "b", "far", *vs)
    of_a, of_b = Written(against("to", "cell", "lo_to", "hi_to")), Written(against("cell", "to", "lo", "hi"))
    by_row = of_a.df.unionByName(of_b.df).where(F.col("far") <= eps).select("a", "b").distinct()
    by_row = Written(by_row)
    left = of_a.df.join(by_row.df, ["a", "b"], "left_anti").select("a", "b", *[F.col(v).alias(f"q{j}") for j, v in enumerate(vs)])
    right = of_b.df.join(by_row.df, ["a", "b"], "left_anti").select("a", "b", *vs)
    by_pair = left.join(right, ["a", "b"]).where(_distance(d, "q", "x") <= eps).select("a", "b").distinct()
    named = components(sure.unionByName(by_row.df).unionByName(by_pair))
    of_cell = Written(boxes.df.select("cell").join(named.withColumnRenamed("node", "cell"), "cell", "left").select(
        "cell", F.coalesce("component", "cell").alias("raw")))
    labelled = core.df.join(of_cell.df, "cell")
    border = judged.df.where(~F.col("core"))
    reach = _with_neighbours(border, d).select(F.col("id").alias("qid"), "to", *[F.col(f"x{j}").alias(f"q{j}") for j in range(d)])
    touched = reach.join(labelled.select(F.col("cell").alias("to"), "raw", *vs), "to").where(_distance(d, "q", "x") <= eps)
    return labelled.select("id", "raw"), touched.select(F.col("qid").alias("id"), "raw").distinct()


# ------------------------------------------------------------------ any number of dimensions: blocks of neighbouring cells

def _gridded(points: DataFrame, d: int, eps: float) -> DataFrame:
    """With the cell of side eps in the dimensions of largest variance."""
    var = points.agg(*[F.var_pop(F.col("__x")[j]).alias(f"v{j}") for j in range(d)]).first()
    dims = sorted(range(d), key=lambda j: -(var[f"v{j}"] or 0.0))[:GRID_DIMS]
    side = eps * (1 + 1e-9) if eps > 0 else 1.0
    out = points.select("*", *[F.floor(F.col("__x")[j] / side).alias(f"c{i}") for i, j in enumerate(dims)])
    for i in range(len(dims), GRID_DIMS):
        out = out.withColumn(f"c{i}", F.lit(0).cast("long"))
    return out.withColumn("cell", _cell([f"c{i}" for i in range(GRID_DIMS)]))


def _meet(queries: DataFrame, refs: DataFrame, local, schema: str, block_rows: int) -> DataFrame:
    """``local`` over each block of queries and each block of references of the 27 cells around it."""
    cs = [f"c{i}" for i in range(GRID_DIMS)]

    def sized(df, name, n):
        return df.groupBy(F.col("cell").alias(name), *cs).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(n))
    steps = F.array(*[F.struct(*[F.lit(v).cast("long").alias(f"o{i}") for i, v in enumerate(o)])
                      for o in itertools.product((-1, 0, 1), repeat=GRID_DIMS)])
    to = sized(queries, "qc", "nq").withColumn("o", F.explode(steps)).withColumn("rc", _cell([F.col(c) + F.col(f"o.o{i}") for i, c in enumerate(cs)]))
    pairs = Written(to.select("qc", "nq", "rc").join(sized(refs, "rc", "nr").select("rc", "nr"), "rc"))

    def block(df, cell, n, own, other, others):
        met = df.drop(*cs).withColumnRenamed("cell", cell).join(pairs.df, cell)
        kept = [F.col(c).alias(c) for c in met.columns if c not in ("nq", "nr")]   # named anew: both sides may be one table
        return met.select(*kept, F.pmod(F.xxhash64("id"), F.col(n)).cast("int").alias(own),
                          F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other))
    keys = ["qc", "rc", "qb", "rb"]
    q, r = block(queries, "qc", "nq", "qb", "rb", "nr"), block(refs, "rc", "nr", "rb", "qb", "nq")
    return q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(local, schema)


def range_counts(df: DataFrame, eps: float, id_col: str, vec: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Number of rows within distance ``eps`` of each row, the row itself included. Rows with a NULL or NaN in the vector are left out."""
    ship_package(df.sparkSession)
    points = _points(df, id_col, vec)
    p = Written(_gridded(points, _dimensions(points), eps))
    return _counts(p.df, eps, block_rows).withColumnRenamed("id", id_col)


def _counts(p: DataFrame, eps: float, block_rows: int) -> DataFrame:
    import numpy as np
    import pandas as pd

    def local(q, r):
        if len(q) == 0 or len(r) == 0:
            return nothing("id", "n")
        n = [near.sum(1) for _, near in within(matrix(q["__x"]), matrix(r["__x"]), eps)]
        return pd.DataFrame({"id": q["id"].to_numpy(), "n": np.concatenate(n).astype("int64")})
    got = _meet(p, p, local, f"id {p.schema['id'].dataType.simpleString()}, n long", block_rows)
    return got.groupBy("id").agg(F.sum("n").alias("n_neighbors"))


def _linked(near):
    """Numbers of rows and columns, of columns' own kind: alike where the links of a boolean matrix hold them together."""
    import numpy as np
    n, m = near.shape
    col, row = np.arange(m), np.full(n, m)
    while True:
        row = np.minimum(row, np.where(near, col[None, :], m).min(1, initial=m))
        new = np.minimum(col, np.where(near, row[:, None], m).min(0, initial=m))
        if (new == col).all():
            return row, col
        col = new


def spanning(near):
    """(i, j) row and column numbers of links that keep together what the links of a boolean matrix hold together."""
    import numpy as np
    row, col = _linked(near)
    rows = np.flatnonzero(row < near.shape[1])
    cols = np.flatnonzero(col != np.arange(near.shape[1]))
    return (rows, row[rows]), (cols, col[cols])


def by_class(near, code):
    """(codes, boolean matrix): which rows have a link to a column of each code."""
    import numpy as np
    order = np.argsort(code, kind="stable")
    names, first = np.unique(code[order], return_index=True)
    return names, np.logical_or.reduceat(near[:, order], first, axis=1)


def forest(strips_of_links, m: int):
    """(i, j), (c, e) as by ``spanning``, of a matrix of ``m`` columns given some rows at a time: columns already held together count as one."""
    import numpy as np
    held, rows, firsts, cols, lasts = np.arange(m), [], [], [], []
    for at, near in strips_of_links:
        some = np.flatnonzero(near.any(0))
        if not len(some):
            continue
        names, met = by_class(near[:, some], held[some])
        (i, j), (c, e) = spanning(met)
        rows.append(at + i)
        firsts.append(names[j])
        cols.append(names[c])
        lasts.append(names[e])
        if len(c):
            to = np.arange(m)
            to[names[c]] = names[e]
            held = to[held]
    none = [np.empty(0, int)]
    return (np.concatenate(none + rows), np.concatenate(none + firsts)), (np.concatenate(none + cols), np.concatenate(none + lasts))


def _block_dbscan(points: DataFrame, d: int, eps: float, min_samples: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """As ``_cell_dbscan``, by blocks of rows."""
    import numpy as np
    import pandas as pd
    p = Written(_gridded(points, d, eps))
    counts = _counts(p.df, eps, block_rows)
    judged = Written(p.df.join(counts, "id").withColumn("core", F.col("n_neighbors") >= min_samples).drop("n_neighbors"))
    core = judged.df.where("core").drop("core")
    kind = p.df.schema["id"].dataType.simpleString()

    def links(q, r):
        if len(q) == 0 or len(r) == 0 or q["qc"].iat[0] > r["rc"].iat[0]:   # each two cells once
            return nothing("a", "b")
        qid, rid = q["id"].to_numpy(), r["id"].to_numpy()
        (i, j), (c, e) = forest(within(matrix(q["__x"]), matrix(r["__x"]), eps), len(r))
        return pd.DataFrame({"a": np.concatenate([qid[i], rid[c]]), "b": np.concatenate([rid[j], rid[e]])})
    named = components(_meet(core, core, links, f"a {kind}, b {kind}", block_rows))
    labelled = Written(core.join(named.withColumnRenamed("node", "id"), "id", "left").withColumn("raw", F.coalesce("component", "id")).drop("component"))

    def touch(q, r):
        if len(q) == 0 or len(r) == 0:
            return nothing("id", "raw")
        code, names = pd.factorize(r["raw"])
        qid, out = q["id"].to_numpy(), []
        for at, near in within(matrix(q["__x"]), matrix(r["__x"]), eps):
            codes, met = by_class(near, code)
            i, c = np.nonzero(met)
            out.append(pd.DataFrame({"id": qid[at + i], "raw": names[codes[c]]}))
        return pd.concat(out, ignore_index=True)
    touched = _meet(judged.df.where(~F.col("core")).drop("core"), labelled.df, touch, f"id {kind}, raw {kind}", block_rows)
    return labelled.df.select("id", "raw"), touched.distinct()


def dbscan(df: DataFrame, id_col: str, vec: str, eps: float, min_samples: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, cluster, core). Core rows have at least ``min_samples`` rows within ``eps`` (itself counted); clusters are connected core rows,
    numbered from 0 by their smallest core id; other rows take the smallest cluster of a core row within eps; the rest, and rows
    with a NULL or NaN in the vector, are noise (-1). Ids are unique and of any orderable type."""
    from tabforge.operators.series import sequence_index
    ship_package(df.sparkSession)
    points = _points(df, id_col, vec)
    d = _dimensions(points)
    if d == 0:
        return df.select(id_col, F.lit(-1).alias("cluster"), F.lit(False).alias("core"))
    core, touched = (_cell_dbscan(points, d, eps, min_samples) if d <= GRID_DIMS and eps > 0
                     else _block_dbscan(points, d, eps, min_samples, block_rows))
    core, touched = Written(core), Written(touched)
    first = Written(core.df.groupBy("raw").agg(F.min("id").alias("first")))
    number = Written(sequence_index(first.df, ["first"], [], "_c").select("raw", F.col("_c").cast("int").alias("cluster")))
    own = core.df.join(number.df, "raw").select("id", "cluster", F.lit(True).alias("core"))
    edge = touched.df.join(number.df, "raw").groupBy("id").agg(F.min("cluster").alias("cluster")).withColumn("core", F.lit(False))
    got = own.unionByName(edge).withColumnRenamed("id", id_col)
    return df.select(id_col).join(got, id_col, "left").select(id_col, F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("core", F.lit(False)).alias("core"))
