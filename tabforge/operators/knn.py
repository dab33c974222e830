"""Exact k nearest neighbours by a pivot join.

A bounded sample of the reference rows are pivots; each reference row belongs to its nearest pivot's part. Parts near each other
fill blocks of at most ``block_rows`` rows, and a large part has blocks of its own. A query first searches the blocks of its own
nearest pivot's part, which bounds its k-th distance. By the triangle inequality it then needs only
those other blocks with a part that can hold something nearer: a part whose rows lie between ``low`` and ``high`` of its pivot has
nothing nearer than ``d - high``, ``low - d`` or half of ``d - d_own``, with ``d`` the query's distance to the pivot. So a query is sent
once to a block, not to each part, where many dimensions leave most parts in reach. A task compares a block of queries with one of
references, by a matrix product whose rounding is bounded, computes exactly the distances that this leaves open, and
keeps the k nearest of each query, never the pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tabforge.session import Written, ship_package

#: Pivots are at most this many, whatever the rows.
MAX_PIVOTS = 1024
#: Rounding of distances that bounds must forgive.
SLACK = 1e-9
#: Rows of a block, and rows compared with a block at once.
BLOCK_ROWS, STRIP = 16384, 256


def as_array(df: DataFrame, vec: str, name: str = "__x") -> DataFrame:
    """The vector column (array or ML vector) as array<double>."""
    if isinstance(df.schema[vec].dataType, T.ArrayType):
        return df.withColumn(name, F.col(vec).cast("array<double>"))
    from pyspark.ml.functions import vector_to_array
    return df.withColumn(name, vector_to_array(F.col(vec)))


def pairwise(Q, R, p: int = 2):
    """Distances of order p (1 or 2) from differences (not by |q|^2 + |r|^2 - 2 q.r, whose rounding can move a pair across a
    radius), some rows at a time to bound memory."""
    import numpy as np
    out = np.empty((Q.shape[0], R.shape[0]), dtype="float64")
    step = max(1, (1 << 21) // max(1, R.shape[0] * max(1, Q.shape[1])))
    for i in range(0, Q.shape[0], step):
        diff = Q[i:i + step, None, :] - R[None, :, :]
        out[i:i + step] = np.abs(diff).sum(-1) if p == 1 else np.sqrt((diff * diff).sum(-1))
    return out


def strips(Q, R, p: int = 2):
    """(at, near, slack) for ``STRIP`` rows of Q at a time: their distances of order p (squared if p is 2) to the rows of R, each at most the
    row's ``slack`` off. Overflow gives values that no comparison holds for."""
    import numpy as np
    with np.errstate(all="ignore"):
        fine = R[np.isfinite(R).all(1)]
        middle = fine.mean(0) if len(fine) else 0.0
        Q, R = Q - middle, np.ascontiguousarray(R - middle)
        unit = 2 * (Q.shape[1] + 16) * np.finfo("float64").eps
        q, r = ((Q * Q).sum(1), (R * R).sum(1)) if p == 2 else (np.abs(Q).sum(1), np.abs(R).sum(1))
        slack = unit * (q + r[np.isfinite(r)].max(initial=0.0))
        turned = np.ascontiguousarray(R.T)
    for at in range(0, len(Q), STRIP):
        some = Q[at:at + STRIP]
        with np.errstate(all="ignore"):
            if p == 2:
                near = some @ turned
                near *= -2
                near += q[at:at + STRIP, None]
                near += r[None, :]
            else:
                near = np.zeros((len(some), len(R)))
                for i in range(0, len(some), 64):
                    for j in range(0, len(R), 2048):
                        tile = near[i:i + 64, j:j + 2048]
                        diff = np.empty(tile.shape)
                        for x, y in zip(some[i:i + 64].T, turned[:, j:j + 2048]):
                            np.subtract(x[:, None], y[None, :], out=diff)
                            np.abs(diff, out=diff)
                            tile += diff
        yield at, near, slack[at:at + STRIP]


def distances(Q, R, i, j, p: int = 2):
    """As ``pairwise``, of the rows i of Q to the rows j of R, one by one."""
    import numpy as np
    out = np.empty(len(i))
    step = max(1, (1 << 21) // max(1, Q.shape[1]))
    for at in range(0, len(i), step):
        diff = Q[i[at:at + step]] - R[j[at:at + step]]
        out[at:at + step] = np.abs(diff).sum(-1) if p == 1 else np.sqrt((diff * diff).sum(-1))
    return out


def within(Q, R, eps: float):
    """(at, boolean matrix) for ``STRIP`` rows of Q at a time: which rows of R are at most ``eps`` away, exactly as by ``pairwise``."""
    import numpy as np
    for at, near, slack in strips(Q, R):
        # where the matrix product is too coarse, as for tiny eps, the pair's own distance decides
        with np.errstate(all="ignore"):
            close = near < (eps * eps * (1 - SLACK) - slack)[:, None]
            i, j = np.nonzero(~(close | (near > (eps * eps * (1 + SLACK) + slack)[:, None])))
            close[i, j] = distances(Q, R, i + at, j) <= eps
        yield at, close


def nearest_in_block(Q, R, k: int, p: int, bound, own=None):
    """(i, j, distance) of the k rows of R nearest to each row of Q, of equal distances the smaller j, without those beyond the row's
    ``bound``; ``own(i, j)`` tells pairs that don't count, of which a row has at most ``own.most``."""
    import numpy as np
    take = min(k + (own.most if own else 0), len(R))
    out = []
    for at, near, slack in strips(Q, R, p):
        with np.errstate(all="ignore"):
            limit = bound[at:at + STRIP] * (1 + SLACK)
            limit = (limit * limit if p == 2 else limit) + slack
            open_ = ~(near > limit[:, None])
            many = np.flatnonzero(open_.sum(1) > take)
            if len(many):
                kth = np.partition(near[many], take - 1, axis=1)[:, take - 1] + 2 * slack[many]
                open_[many] &= ~(near[many] > kth[:, None])
        i, j = np.nonzero(open_)
        # rows with many equal distances leave many pairs open: some rows at a time
        cuts = np.flatnonzero(np.diff(i, prepend=-1))
        cuts = [0, *cuts[1:][np.diff(cuts[:-1] >> 18, prepend=0) > 0].tolist(), len(i)]
        for a, b in zip(cuts, cuts[1:]):
            row, col = i[a:b], j[a:b]
            d = distances(Q, R, row + at, col, p)
            keep = np.isfinite(d) & (d <= bound[row + at] * (1 + SLACK))
            if own:
                keep &= ~own(row + at, col)
            row, col, d = row[keep], col[keep], d[keep]
            order = np.lexsort((col, d, row))
            row, col, d = row[order], col[order], d[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
            out.append((row[keep] + at, col[keep], d[keep]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))


def matrix(column):
    """A pandas column of arrays as a matrix."""
    import numpy as np
    return np.array(column.tolist(), dtype="float64").reshape(len(column), -1)


def nothing(*names):
    """A frame without rows that goes back to Spark as any type."""
    import pandas as pd
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in names})


def _pivots(ref: DataFrame, n: int) -> dict:
    """group -> matrix of its pivots, of ``n`` rows in all, by hash of the vector (so copies are one pivot)."""
    import numpy as np
    hashed = ref.withColumn("h", F.xxhash64("__x", "__g"))
    least = hashed.select("h").distinct().orderBy("h").limit(n)
    rows = hashed.join(F.broadcast(least), "h").groupBy("h").agg(F.first("__g").alias("__g"), F.first("__x").alias("__x")).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["__g"], []).append(list(r["__x"]))
    return {g: np.array(v, dtype="float64") for g, v in by.items()}


def _assigned(df: DataFrame, pivots: dict, p: int) -> DataFrame:
    """With (part, away): the nearest pivot of the row's group and its distance; part -1 where the group has no pivot."""
    import numpy as np

    def run(batches):
        for pdf in batches:
            part, away = np.full(len(pdf), -1, "int32"), np.zeros(len(pdf))
            g = pdf["__g"].to_numpy()
            for of in set(g.tolist()) & set(pivots):
                at = np.flatnonzero(g == of)
                d = pairwise(matrix(pdf["__x"].iloc[at]), pivots[of], p)
                part[at] = d.argmin(1)
                away[at] = d.min(1)
            yield pdf.assign(part=part, away=away)
    fields = [*df.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("away", T.DoubleType())]
    return df.mapInPandas(run, T.StructType(fields))


def _order(points):
    """Row numbers of points so that neighbours in order are near each other: halves by the dimension of largest variance."""
    import numpy as np
    todo, out = [np.arange(len(points))], []
    while todo:
        at = todo.pop()
        if len(at) <= 1:
            out.extend(at.tolist())
            continue
        at = at[np.argsort(points[at, points[at].var(0).argmax()], kind="stable")]
        todo += [at[len(at) // 2:], at[:len(at) // 2]]
    return out


def _blocks(sizes: DataFrame, pivots: dict, block_rows: int):
    """Blocks of the parts (__g, part, n) as a frame (__g, part, first, blocks) and, for groups with pivots, as group -> part -> (first, blocks)."""
    have: dict = {}
    for x in sizes.where("part >= 0").collect():               # one row for a pivot at most
        have.setdefault(x["__g"], {})[x["part"]] = x["n"]
    table: dict = {}
    for of, counts in have.items():
        first, filled, at = 0, 0, table.setdefault(of, {})
        for part in _order(pivots[of]):
            n = counts.get(part, 0)
            if not n:
                continue
            if filled and filled + n > block_rows:
                first, filled = first + 1, 0
            blocks = math.ceil(n / block_rows)
            at[part] = (first, blocks)
            if blocks > 1:
                first, filled = first + blocks, 0
            else:
                filled += n
    rows = [(of, int(part), *at) for of, parts in table.items() for part, at in parts.items()]
    known = sizes.sparkSession.createDataFrame(rows, "__g string, part int, first int, blocks int")
    rest = sizes.where("part < 0").select("__g", "part", F.lit(0).alias("first"), F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    return known.unionByName(rest), table


def _query_rows(n: int, block_rows: int) -> int:
    """Rows of a block of queries: less than of a block of references where few queries would make few tasks."""
    return min(block_rows, max(2048, math.ceil(n / 64)))


def _in_blocks(df: DataFrame, blocks: DataFrame, key: str, name: str) -> DataFrame:
    """Each row with the number of its block as column ``name``."""
    return df.join(blocks, ["__g", "part"]).withColumn(name, F.col("first") + F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).drop("first", "blocks")


def _search(asks: DataFrame, ref: DataFrame, k: int, p: int, exclude_self: bool) -> DataFrame:
    """(qid, rid, dist): the k nearest rows of each block ``rb`` that a query asks, none beyond its ``kth`` distance if it has one."""
    # named anew: queries and references may be one table
    asks, ref = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (asks, ref))
    import numpy as np
    import pandas as pd
    keys = ["__g", "qb", "rb"]
    q = asks.select(*keys, "qid", "__x", "kth")
    met = asks.select(*[F.col(c).alias(c) for c in keys]).distinct()
    r = ref.select("__g", "rb", "rid", "__x").join(met, ["__g", "rb"]).select(*[F.col(c).alias(c) for c in (*keys, "rid", "__x")])

    def local(qpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(rpdf) == 0:
            return nothing("qid", "rid", "dist")
        rpdf = rpdf.sort_values("rid", kind="stable")         # equal distances by reference id
        rid, qid = rpdf["rid"].to_numpy(), qpdf["qid"].to_numpy()
        own = None
        if exclude_self:
            def own(i, j):
                return qid[i] == rid[j]
            own.most = int(rpdf["rid"].value_counts(dropna=False).iloc[0])
        i, j, dist = nearest_in_block(matrix(qpdf["__x"]), matrix(rpdf["__x"]), k, p, qpdf["kth"].fillna(np.inf).to_numpy(dtype="float64"), own)
        return pd.DataFrame({"qid": qid[i], "rid": rid[j], "dist": dist})

    schema = f"qid {asks.schema['qid'].dataType.simpleString()}, rid {ref.schema['rid'].dataType.simpleString()}, dist double"
    return q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(local, schema)


def _nearest(candidates: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("dist", "rid")   # at most k rows from each block that was searched
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(query: DataFrame, ref: DataFrame, k: int, qid: str, rid: str, vec: str, group: str | None = None,
        exclude_self: bool = False, block_rows: int = BLOCK_ROWS, p: int = 2, n_pivots: int | None = None) -> DataFrame:
    """The k nearest reference rows of each query row as (qid, rank, rid, dist), of equal distances the smaller id first.

    ``group`` restricts neighbours to rows of the same group; pivots, parts and bounds are then those of the group alone.
    ``p`` is 1 (city block) or 2 (Euclidean). Ids are unique and of any orderable type; rows with a NULL vector or a vector with a
    NULL in it are no neighbours and have none.
    """
    import numpy as np
    import pandas as pd
    ship_package(query.sparkSession)
    g = F.coalesce(F.col(group).cast("string"), F.lit("")).alias("__g") if group else F.lit("").alias("__g")

    def rows(df, key, name):
        df = as_array(df, vec).where(F.col("__x").isNotNull() & ~F.exists("__x", lambda v: v.isNull()))
        return df.select(F.col(key).alias(name), "__x", g)
    refs = rows(ref, rid, "rid")
    n = refs.count()
    if n <= block_rows and n_pivots is None:
        # one block a group
        nq = rows(query, qid, "qid")
        m = nq.count()
        asks = nq.select("*", F.lit(0).alias("rb"), F.pmod(F.xxhash64("qid"), F.lit(max(1, math.ceil(m / _query_rows(m, block_rows))))).cast("int").alias("qb"),
                         F.lit(None).cast("double").alias("kth"))
        got = _nearest(_search(asks, refs.withColumn("rb", F.lit(0)), k, p, exclude_self), k)
        return got.select(F.col("qid").alias(qid), "rank", F.col("rid").alias(f"nn_{rid}" if rid == qid else rid), "dist")
    pivots = _pivots(refs, n_pivots or max(1, min(MAX_PIVOTS, math.isqrt(n))))
    r = Written(_assigned(refs, pivots, p))
    parts = Written(r.df.groupBy("__g", "part").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high")))
    q = Written(_assigned(rows(query, qid, "qid"), pivots, p))
    of_ref, ref_table = _blocks(parts.df, pivots, block_rows)
    of_query, _ = _blocks(q.df.groupBy("__g", "part").agg(F.count(F.lit(1)).alias("n")), pivots, _query_rows(q.df.count(), block_rows))
    r_blocks = _in_blocks(r.df, of_ref, "rid", "rb")
    q_blocks = _in_blocks(q.df, of_query, "qid", "qb")
    mine = q_blocks.join(of_ref, ["__g", "part"]).select(
        "__g", "qb", "qid", "__x", F.lit(None).cast("double").alias("kth"), F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("rb"))
    own = Written(_nearest(_search(mine, r_blocks, k, p, exclude_self), k))
    # one row for a pivot at most; the part of each block and the first row of each block's parts
    table: dict = {}
    for x in parts.df.where("part >= 0").collect():
        table.setdefault(x["__g"], []).append((x["part"], x["n"], x["low"], x["high"]))
    table = {of: np.array(sorted(v), dtype="float64") for of, v in table.items()}
    held: dict = {}
    for of, v in table.items():
        pairs = sorted((first + b, i) for i, part in enumerate(v[:, 0].astype(int)) for first, blocks in [ref_table[of][part]] for b in range(blocks))
        block, at = np.array(pairs).T
        own_blocks = {part: ref_table[of][part] for part in ref_table[of]}
        held[of] = (at, np.flatnonzero(np.diff(block, prepend=-1)), own_blocks)

    def other_blocks(batches):
        for pdf in batches:
            names = pdf["__g"].to_numpy()
            for of in set(names.tolist()) & set(table):
                part, count, low, high = table[of].T
                at_part, starts, own_blocks = held[of]
                group = np.flatnonzero(names == of)
                # some rows at a time: each asks every block at most
                for s in range(0, len(group), 512):
                    mine = pdf.iloc[group[s:s + 512]]
                    d = pairwise(matrix(mine["__x"]), pivots[of][part.astype(int)], p)
                    bound = mine["kth"].fillna(np.inf).to_numpy(dtype="float64")
                    if not exclude_self:
                        # the nearest parts that together have enough rows bound the k-th distance too
                        far = d + high
                        by = np.argsort(far, axis=1)
                        enough = np.cumsum(count[by], axis=1) >= k
                        at = np.argmax(enough, axis=1)
                        bound = np.minimum(bound, np.where(enough.any(1), np.take_along_axis(far, by, 1)[np.arange(len(d)), at], np.inf))
                    nearest = mine["away"].to_numpy()[:, None]
                    least = np.maximum(np.maximum(d - high, low - d), (d - nearest) / 2)
                    hit = least <= bound[:, None] * (1 + SLACK) + SLACK
                    hit = np.logical_or.reduceat(hit[:, at_part], starts, axis=1)
                    searched = np.array([own_blocks.get(x, (0, 0)) for x in mine["part"]])
                    number = np.arange(hit.shape[1])[None, :]
                    hit &= (number < searched[:, :1]) | (number >= searched.sum(1)[:, None])
                    i, j = np.nonzero(hit)
                    yield pd.DataFrame({"__g": of, "qb": mine["qb"].to_numpy()[i], "rb": j.astype("int32"), "qid": mine["qid"].to_numpy()[i],
                                        "__x": mine["__x"].to_numpy()[i], "kth": bound[i]})

    bounds = own.df.where(F.col("rank") == k).select("qid", F.col("dist").alias("kth"))
    asks = Written(q_blocks.join(bounds, "qid", "left").select("__g", "part", "away", "qb", "qid", "__x", "kth").mapInPandas(
        other_blocks, f"__g string, qb int, rb int, qid {query.schema[qid].dataType.simpleString()}, __x array<double>, kth double"))
    both = own.df.drop("rank").unionByName(_search(asks.df, r_blocks, k, p, exclude_self))
    return _nearest(both, k).select(F.col("qid").alias(qid), "rank", F.col("rid").alias(f"nn_{rid}" if rid == qid else rid), "dist")


def votes(nn: DataFrame, qid: str, label: str, weights: str = "uniform") -> DataFrame:
    """(qid, label, votes) from neighbours with their label: one each, or by inverse distance, where neighbours
    at distance 0 alone vote if there are any."""
    if weights == "uniform":
        w = F.lit(1.0)
    elif weights == "distance":
        zero = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy(qid))
        nn = nn.withColumn("__zero", zero)
        w = F.when(F.col("__zero") == 1, (F.col("dist") == 0).cast("double")).otherwise(1 / F.col("dist"))
    else:
        raise ValueError(f"unknown weights {weights!r}")
    return nn.groupBy(qid, label).agg(F.sum(w).alias("votes"))


def winners(votes_: DataFrame, qid: str, label: str) -> DataFrame:
    """(qid, prediction): the label with most votes, the smallest of those with as many."""
    best = votes_.groupBy(qid).agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col(label).alias("l"))).alias("b"))
    return best.select(qid, F.col("b.l").alias("prediction"))


def knn_classify(train: DataFrame, test: DataFrame, k: int, id_col: str, vec: str, label: str, weights: str = "uniform", p: int = 2, **kw) -> DataFrame:
    """k-NN vote for every test row, ties to the smallest label."""
    nn = knn(test, train.withColumnRenamed(id_col, "__rid"), k, id_col, "__rid", vec, p=p, **kw)
    named = nn.join(train.select(F.col(id_col).alias("__rid"), F.col(label).alias("__lab")), "__rid")
    return winners(votes(named, id_col, "__lab", weights), id_col, "__lab")


class KNNClassifier:
    """k-NN as a model of the training menu: ``fit`` keeps the rows (written, not collected), ``transform`` adds prediction
    and probability. Labels are 0..n_classes-1, and ``id_cols`` name a row."""

    def __init__(self, id_cols, n_classes: int, n_neighbors: int = 5, weights: str = "uniform", p: int = 2,
                 features_col: str = "features", label_col: str = "label"):
        self.id_cols, self.n_classes, self.k, self.weights, self.p = list(id_cols), n_classes, n_neighbors, weights, p
        self.features_col, self.label_col = features_col, label_col

    def fit(self, df: DataFrame) -> "KNNModel":
        rows = df.select(row_key(self.id_cols).alias("__rid"), self.features_col, self.label_col)
        # rows without ids, such as synthetic ones, are told apart by their features
        keyed = rows.withColumn("__rid", F.concat_ws("|", "__rid", F.md5(F.to_json(F.struct(as_json(rows, self.features_col))))))
        return KNNModel(self, Written(keyed).df.dropDuplicates(["__rid"]))


class KNNModel:
    def __init__(self, of: KNNClassifier, train: DataFrame):
        self.of, self.train = of, train

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector
        of = self.of
        asked = df.withColumn("__qid", row_key(of.id_cols))
        nn = knn(asked, self.train, of.k, "__qid", "__rid", of.features_col, p=of.p)
        named = nn.join(self.train.select("__rid", F.col(of.label_col).alias("__lab")), "__rid")
        v = votes(named, "__qid", "__lab", of.weights)
        share = [F.coalesce(F.sum(F.when(F.col("__lab") == i, F.col("votes"))), F.lit(0.0)) / F.sum("votes") for i in range(of.n_classes)]
        found = v.groupBy("__qid").agg(array_to_vector(F.array(*share)).alias("probability"))
        best = winners(v, "__qid", "__lab").withColumn("prediction", F.col("prediction").cast("double"))
        return asked.join(found.join(best, "__qid"), "__qid", "left").drop("__qid")


def as_json(df: DataFrame, features: str):
    if isinstance(df.schema[features].dataType, T.ArrayType):
        return F.col(features).alias("f")
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(features)).alias("f")


def row_key(id_cols):
    """One string that names a row by all its id columns."""
    return F.to_json(F.struct(*[F.col(c) for c in id_cols]))


def estimate_eps(df: DataFrame, id_col: str, vec: str, k: int = 20, **kw) -> float:
    """Median distance to the min(k, n-1)-th nearest row, the row itself counted as first."""
    from tabforge.operators.quantiles import exact_quantiles
    n = df.count()
    kk = min(k, n - 1)
    kth = knn(df, df, kk, id_col, id_col, vec, **kw).where(F.col("rank") == kk).select("dist")
    return exact_quantiles(Written(kth).df, ["dist"], (0.5,))[("dist", 0.5)]
