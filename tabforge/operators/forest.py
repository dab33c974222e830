"""Random forests over many rows (M6, M9), as Spark ML's models.

Spark ML's forest keeps an object with a bag weight a tree for every row, and every task sends the sums of all nodes, most of
them empty where a node has few rows. Here rows are binned once into blocks of bytes, and trees grow in two ways:

* a node of many rows by a pass over the blocks: a task walks its rows down the trees so far and sums label and weight by
  (node, feature, bin); the sums of all tasks meet by (tree, nodes), where the best splits are found, so only splits
  reach the driver. Bags are drawn anew in each pass, seeded by (seed, tree, block);
* a node whose rows are fewer than its sums would be goes with them to one task, which grows the rest of its subtree. A task
  gets at most ``SUBTREE_ROWS`` rows a node.

Trees follow Spark's rules: at most ``maxBins`` bins at quantiles of a sample of 10,000 rows, bags as Poisson weights, a
third (regression) or the square root (classification) of the features a node, variance or Gini gain, sibling leaves of one
prediction merged. The draws differ from Spark's, so single trees do too. The model is written in Spark's format and loaded.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from tabforge.session import Written, checkpoint_dir, ship_package

BLOCK_BYTES, BLOCK_ROWS = 1 << 21, 1 << 17   # of binned features, at most
SAMPLE_ROWS = 10_000            # sample of which the bins are quantiles, as in Spark
SUBTREE_ROWS = 1 << 16          # rows of a node that one task may grow
SUM_CELLS = 1 << 18             # sums that one row of a pass's output holds
TASK_BYTES = 1 << 25            # rows of nodes that a task gets, about
CHUNK_ROWS = 1 << 15            # rows of a subtree that are summed at once

# Poisson(1) by 16 random bits
_POISSON = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)]),
                           (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def fits(est) -> bool:
    """Is ``est`` a random forest whose parameters are the ones handled here?"""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor
    return (isinstance(est, (RandomForestClassifier, RandomForestRegressor)) and est.getNumTrees() > 1 and est.getBootstrap()
            and est.getFeatureSubsetStrategy() == "auto" and est.getSubsamplingRate() == 1 and est.getMinInstancesPerNode() == 1
            and est.getMinInfoGain() == 0 and est.getMinWeightFractionPerNode() == 0 and est.getMaxBins() <= 256
            and est.getImpurity() in ("variance", "gini")
            and (isinstance(est, RandomForestClassifier) or not (est.isSet("weightCol") and est.getWeightCol())))


# ---------------------------------------------------------------- bins and blocks

def split_points(values: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` thresholds between the distinct values of a sample, at about equal counts."""
    v, counts = np.unique(values[~np.isnan(values)], return_counts=True)
    between = (v[:-1] + v[1:]) / 2
    if len(between) <= most:
        return between
    stride = counts.sum() / (most + 1)
    seen, target, out = int(counts[0]), stride, []
    for i, c in enumerate(counts[1:].tolist()):
        if abs(seen - target) < abs(seen + c - target):
            out.append(between[i])
            target += stride
        seen += c
    return np.array(out[:most])


def _block_batches(batches, thresholds, shift: float, most: int):
    """Blocks of binned rows; a block's id names its partition and place."""
    import pyarrow as pa
    from pyspark import TaskContext
    at, width = TaskContext.get().partitionId() << 32, len(thresholds)
    for batch in batches:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
        y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
        codes = np.empty(x.shape, dtype=np.uint8)
        for f, t in enumerate(thresholds):
            codes[:, f] = np.searchsorted(t, x[:, f])
        for i in range(0, len(y), most):
            part = slice(i, i + most)
            yield pa.RecordBatch.from_pydict({"id": [at], "codes": [codes[part].tobytes()], "y": [(y[part] - shift).tobytes()],
                                              "w": [w[part].tobytes()]})
            at += 1


def _blocks(batches, width: int):
    """(id, codes, label, weight) of the blocks of a task."""
    return [(i, np.frombuffer(c, np.uint8), np.frombuffer(y), np.frombuffer(w))
            for b in batches for i, c, y, w in zip(*(b.column(k).to_pylist() for k in ("id", "codes", "y", "w")))]


def _bag(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    draws = np.random.Generator(np.random.SFC64([seed, tree, block])).integers(0, 1 << 16, n, dtype=np.uint16)
    return _POISSON[draws]


def _subsets(seed, nodes: int, width: int, k: int) -> np.ndarray:
    """``k`` of ``width`` features for each node."""
    if k == width:
        return np.tile(np.arange(width), (nodes, 1))
    return np.argsort(np.random.default_rng(seed).random((nodes, width)), axis=1)[:, :k]


# ---------------------------------------------------------------- sums and splits

def _totals(nd, nodes: int, w, y, classes: int) -> np.ndarray:
    """(node, statistic): weights by class, or weight, label and square of the label."""
    if classes:
        return np.bincount(nd * classes + y.astype(np.int64), w, nodes * classes).reshape(nodes, classes)
    return np.stack([np.bincount(nd, v, nodes) for v in (w, w * y, w * y * y)], axis=1)


def _sums(codes, base, nd, subsets, w, y, classes: int, bins: int) -> np.ndarray:
    """(feature of the node, node, bin, channel): weights by class, or weight and label."""
    nodes, k = subsets.shape
    out = np.empty((k, nodes, bins, classes or 2))
    at = nd * (bins * classes) + y.astype(np.int64) if classes else nd * bins
    wy = None if classes else w * y
    for j, features in enumerate(np.ascontiguousarray(subsets.T)):
        code = codes.take(base + features.take(nd))
        if classes:
            out[j] = np.bincount(code.astype(np.int64) * classes + at, w, nodes * bins * classes).reshape(nodes, bins, classes)
        else:
            key = code + at
            out[j, ..., 0] = np.bincount(key, w, nodes * bins).reshape(nodes, bins)
            out[j, ..., 1] = np.bincount(key, wy, nodes * bins).reshape(nodes, bins)
    return out


def _best(sums, subsets, classes: int):
    """(gain, feature, bin, left channels) of the best split of each node; a gain of -inf where there is none."""
    left = sums.cumsum(axis=2)
    total, left = left[0, :, -1], left[:, :, :-1]
    right = total[:, None] - left
    with np.errstate(all="ignore"):
        if classes:
            n, nl, nr = total.sum(-1), left.sum(-1), right.sum(-1)
            score = (left * left).sum(-1) / nl + (right * right).sum(-1) / nr
            parent = (total * total).sum(-1) / n
        else:
            n, nl, nr = total[:, 0], left[..., 0], right[..., 0]
            score = left[..., 1] ** 2 / nl + right[..., 1] ** 2 / nr
            parent = total[:, 1] ** 2 / n
        few = 1e-9 * n[:, None]
        score = np.where((nl > few) & (nr > few), score, -np.inf)
        nodes = np.arange(len(n))
        flat = score.transpose(1, 0, 2).reshape(len(n), -1)
        slot, code = np.divmod(flat.argmax(axis=1), score.shape[2])
        return (flat.max(axis=1) - parent) / n, subsets[nodes, slot], code, left[slot, nodes, code]


# ---------------------------------------------------------------- a pass over the blocks

def _walk(codes, base, tree, steps: int):
    """The node that each row reaches; leaves lead to themselves."""
    feature, code, left = tree[:3]
    node = np.zeros(len(base), dtype=np.int64)
    for _ in range(steps):
        node = left.take(node) + (codes.take(base + feature.take(node)) > code.take(node))
    return node


def _bagged(blocks, t: int, tree, steps: int, s: dict):
    """Of each block the bagged rows that reach a wanted node: (codes, place of the row, wanted node, label, weight, bag)."""
    for block, codes, y, cw in blocks:
        bag = _bag(s["seed"], t, block, len(y))
        rows = np.flatnonzero(bag)
        nd = tree[3].take(_walk(codes, rows * s["width"], tree, steps))
        rows, nd = rows[nd >= 0], nd[nd >= 0]
        if len(rows):
            yield codes, rows * s["width"], nd, y[rows], cw[rows] * bag[rows], bag[rows]


def _node_range(s: dict) -> int:
    return max(1, SUM_CELLS // (s["k"] * s["bins"] * (s["classes"] or 2)))


def _pass_sums(batches, s: dict):
    """(tree, first node, sums, totals, bag) of the open nodes over the rows of a task."""
    import pyarrow as pa
    blocks = _blocks(batches, s["width"])
    for t, tree in s["trees"].items():
        nodes = int(tree[3].max()) + 1
        subsets = _subsets([s["seed"], t, s["level"]], nodes, s["width"], s["k"])
        sums = totals = bags = 0
        for codes, base, nd, y, w, bag in _bagged(blocks, t, tree, s["level"], s):
            if s["split"]:
                sums = sums + _sums(codes, base, nd, subsets, w, y, s["classes"], s["bins"])
            totals = totals + _totals(nd, nodes, w, y, s["classes"])
            bags = bags + np.bincount(nd, bag, nodes)
        if isinstance(totals, int):
            continue
        step = _node_range(s)
        for at in range(0, nodes, step):
            part = slice(at, at + step)
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array([t], pa.int32()), "at": pa.array([at], pa.int32()),
                "sums": [np.ascontiguousarray(sums[:, part]).tobytes() if s["split"] else b""],
                "totals": [totals[part].tobytes()], "bags": [bags[part].tobytes()]})


def _pass_best(table, s: dict):
    """The best splits of a range of nodes from the sums of all tasks."""
    import pyarrow as pa
    t, at = table.column("tree")[0].as_py(), table.column("at")[0].as_py()
    totals, bags, sums = (sum(np.frombuffer(x) for x in table.column(c).to_pylist()) for c in ("totals", "bags", "sums"))
    nodes, classes = len(bags), s["classes"]
    found = {"totals": totals, "bags": bags}
    if s["split"]:
        every = int(s["trees"][t][3].max()) + 1
        subsets = _subsets([s["seed"], t, s["level"]], every, s["width"], s["k"])[at:at + nodes]
        gain, feature, code, left = _best(sums.reshape(s["k"], nodes, s["bins"], classes or 2), subsets, classes)
        found |= {"gain": gain, "feature": feature.astype(float), "code": code.astype(float), "left": left}
    return pa.table({"tree": pa.array([t], pa.int32()), "at": pa.array([at], pa.int32()),
                     **{c: [np.ascontiguousarray(found.get(c, np.empty(0))).tobytes()] for c in _SPLIT}})


_SPLIT = ("totals", "bags", "gain", "feature", "code", "left")


# ---------------------------------------------------------------- subtrees in tasks

def _moved(batches, s: dict):
    """The bagged rows of the nodes whose subtrees are grown in tasks, a row for each node and task."""
    import pyarrow as pa
    blocks, width = _blocks(batches, s["width"]), s["width"]
    for t, tree in s["trees"].items():
        found = [(codes.reshape(-1, width)[base // width], nd, y, w, bag)
                 for codes, base, nd, y, w, bag in _bagged(blocks, t, tree, s["level"], s)]
        if not found:
            continue
        codes, nd, y, w, bag = map(np.concatenate, zip(*found))
        order = np.argsort(nd, kind="stable")
        ends = np.cumsum(np.bincount(nd))
        wanted = np.flatnonzero(tree[3] >= 0)
        out = {c: [] for c in ("tree", "node", "codes", "y", "w", "bag")}
        for i, (a, b) in enumerate(zip(ends - np.bincount(nd), ends)):
            if a < b:
                rows = order[a:b]
                for c, v in zip(out, (t, int(wanted[i]), codes[rows].tobytes(), y[rows].tobytes(), w[rows].tobytes(), bag[rows].tobytes())):
                    out[c].append(v)
        yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int32() if c in ("tree", "node") else pa.binary()) for c, v in out.items()})


def grow(codes, y, w, bag, level: int, seed, s: dict) -> dict:
    """The nodes of a subtree from its rows, level by level: feature, bin, first child, gain, totals and bag."""
    width, k, bins, classes = s["width"], s["k"], s["bins"], s["classes"]
    perm, sizes, first, out = np.arange(len(y)), np.array([len(y)]), 0, []
    while True:
        nodes = len(sizes)
        ends = np.cumsum(sizes)
        feature, code, gain = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.full(nodes, -np.inf)
        totals, bags = [], []
        subsets = _subsets([*seed, level], nodes, width, k) if level < s["depth"] else None
        most = max(1, (1 << 20) // (k * bins * (classes or 2)))
        a = 0
        while a < nodes:
            b = max(a + 1, min(a + most, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK_ROWS, "right"))))
            rows = perm[ends[a] - sizes[a]:ends[b - 1]]
            nd = np.repeat(np.arange(b - a), sizes[a:b])
            totals.append(_totals(nd, b - a, w[rows], y[rows], classes))
            bags.append(np.bincount(nd, bag[rows], b - a))
            if subsets is not None:
                sums = _sums(codes, rows * width, nd, subsets[a:b], w[rows], y[rows], classes, bins)
                gain[a:b], feature[a:b], code[a:b], _ = _best(sums, subsets[a:b], classes)
            a = b
        split = gain > s["least"]
        left = np.full(nodes, -1)
        left[split] = first + nodes + 2 * np.arange(split.sum())
        out.append({"feature": feature, "code": code, "left": left, "gain": gain, "totals": np.concatenate(totals), "bags": np.concatenate(bags)})
        if not split.any():
            return {c: np.concatenate([x[c] for x in out]) for c in out[0]}
        node = np.repeat(np.arange(nodes), sizes)
        perm, node = perm[split[node]], node[split[node]]
        key = (2 * (np.cumsum(split) - 1))[node] + (codes.take(perm * width + feature[node]) > code[node])
        perm = perm[np.argsort(key.astype(np.uint16) if nodes < 1 << 14 else key, kind="stable")]
        sizes, first, level = np.bincount(key, minlength=2 * int(split.sum())), first + nodes, level + 1


_NODE = ("feature", "code", "left", "gain", "totals", "bags")


def _grown(table, s: dict):
    import pyarrow as pa
    t, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
    codes, y, w, bag = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
                        for c, kind in (("codes", np.uint8), ("y", float), ("w", float), ("bag", np.uint8)))
    got = grow(codes, y, w, bag, s["levels"][t][node], (s["seed"], t, node), s)
    return pa.table({"tree": pa.array([t], pa.int32()), "node": pa.array([node], pa.int32()),
                     **{c: [np.ascontiguousarray(got[c], dtype=float).tobytes()] for c in _NODE}})


# ---------------------------------------------------------------- the forest

class _Tree:
    """A tree under construction: a row a node, children after their parent and side by side."""

    def __init__(self, channels: int, n: int):
        self.feature, self.code, self.left = np.zeros(1, np.int64), np.full(1, 255), np.zeros(1, np.int64)
        self.gain, self.totals, self.bags = np.full(1, -1.0), np.zeros((1, channels)), np.zeros(1)
        self.weight = np.array([float(n)])      # rows of a node, about
        self.open = np.zeros(1, np.int64)
        self.moved: dict[int, int] = {}         # nodes grown in tasks, with their levels

    def add(self, count: int) -> int:
        """New leaves at the end; the first one's number."""
        at = len(self.feature)
        self.feature = np.concatenate([self.feature, np.zeros(count, np.int64)])
        self.code = np.concatenate([self.code, np.full(count, 255)])
        self.left = np.concatenate([self.left, np.arange(at, at + count)])
        self.gain = np.concatenate([self.gain, np.full(count, -1.0)])
        self.totals = np.concatenate([self.totals, np.zeros((count, self.totals.shape[1]))])
        self.bags, self.weight = (np.concatenate([v, np.zeros(count)]) for v in (self.bags, self.weight))
        return at

    def route(self, wanted) -> tuple:
        """What a pass needs: the tree so far, and the places of the wanted nodes, -1 for others."""
        at = np.full(len(self.feature), -1)
        at[wanted] = np.arange(len(wanted))
        return self.feature, self.code.astype(np.uint8), self.left, at


def fit_forest(est, df: DataFrame, n: int):
    """The random forest of ``est`` over the ``n`` rows of ``df``, as Spark ML's fitted model."""
    from pyspark.ml.classification import RandomForestClassifier
    spark = df.sparkSession
    ship_package(spark)
    kind = isinstance(est, RandomForestClassifier)
    seed, depth = est.getSeed() % (1 << 62), est.getMaxDepth()
    weight = est.getWeightCol() if est.isDefined("weightCol") and est.isSet("weightCol") and est.getWeightCol() else None
    rows = df.select(vector_to_array(est.getFeaturesCol()).alias("x"), F.col(est.getLabelCol()).cast("double").alias("y"),
                     (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    label = rows.agg(F.avg("y").alias("mean"), F.var_pop("y").alias("var"), F.max("y").alias("most")).first()
    classes = max(2, int(label["most"]) + 1) if kind else 0
    shift = 0.0 if kind else label["mean"]
    share = max(est.getMaxBins() ** 2, SAMPLE_ROWS) / n
    sample = (rows if share >= 1 else rows.sample(False, share, seed)).select("x").toArrow().column("x")
    width = len(sample[0])
    values = sample.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(sample), width)
    thresholds = [split_points(values[:, f], min(est.getMaxBins(), n) - 1) for f in range(width)]
    s = {"seed": seed, "width": width, "classes": classes, "depth": depth, "bins": max(2, 1 + max(map(len, thresholds))),
         "k": math.ceil(math.sqrt(width) if kind else width / 3), "least": 1e-12 * (1.0 if kind else label["var"] or 0.0)}
    per_block = max(1, min(BLOCK_ROWS, BLOCK_BYTES // width))
    written = Written(rows.mapInArrow(lambda it: _block_batches(it, thresholds, shift, per_block), "id long, codes binary, y binary, w binary"))
    try:
        trees = _grow_trees(written.df, s, est.getNumTrees(), n)
    finally:
        written.drop()
    return _spark_model(est, trees, thresholds, shift, s, spark)


def _grow_trees(blocks: DataFrame, s: dict, count: int, n: int) -> list[_Tree]:
    classes, depth = s["classes"], s["depth"]
    channels = classes or 3
    tasks = blocks.rdd.getNumPartitions()
    row_bytes, node_bytes = s["width"] + 17, 8 * s["k"] * s["bins"] * (classes or 2)
    trees = [_Tree(channels, n) for _ in range(count)]
    for level in range(depth + 1):
        for t in trees:
            if level < depth:
                rows = t.weight[t.open]
                sums = ((1 << (depth - level)) - 1) * node_bytes * tasks      # of the levels below, from all tasks
                few = (rows <= SUBTREE_ROWS) & (rows * row_bytes <= sums)
                t.moved |= dict.fromkeys(t.open[few].tolist(), level)
                t.open = t.open[~few]
        wanted = {i: t.route(t.open) for i, t in enumerate(trees) if len(t.open)}
        if not wanted:
            break
        spec = s | {"level": level, "split": level < depth, "trees": wanted}
        sums = blocks.mapInArrow(lambda it: _pass_sums(it, spec), "tree int, at int, sums binary, totals binary, bags binary")
        best = sums.groupBy("tree", "at").applyInArrow(lambda table: _pass_best(table, spec),
                                                       "tree int, at int, " + ", ".join(f"{c} binary" for c in _SPLIT)).collect()
        for i in wanted:
            got = {c: np.concatenate([np.frombuffer(r[c]) for r in sorted((r for r in best if r["tree"] == i), key=lambda r: r["at"])])
                   for c in _SPLIT}
            _split_nodes(trees[i], got, classes, channels, s["least"], level < depth)
    _attach_subtrees(trees, blocks, s, row_bytes)
    return trees


def _split_nodes(t: _Tree, got: dict, classes: int, channels: int, least: float, split: bool) -> None:
    """The open nodes of a tree after a pass; their children are the next open nodes."""
    t.totals[t.open], t.bags[t.open] = got["totals"].reshape(-1, channels), got["bags"]
    if not split:
        t.open = t.open[:0]
        return
    good = got["gain"] > least
    nodes, left = t.open[good], got["left"].reshape(len(good), -1)[good]
    at = t.add(2 * len(nodes))
    t.feature[nodes], t.code[nodes], t.gain[nodes] = got["feature"][good], got["code"][good], got["gain"][good]
    t.left[nodes] = at + 2 * np.arange(len(nodes))
    rows = left.sum(1) if classes else left[:, 0]
    every = t.totals[nodes].sum(1) if classes else t.totals[nodes, 0]
    t.weight[t.left[nodes]], t.weight[t.left[nodes] + 1] = rows, every - rows
    t.open = np.arange(at, at + 2 * len(nodes))


def _attach_subtrees(trees: list[_Tree], blocks: DataFrame, s: dict, row_bytes: int) -> None:
    moved = {i: t for i, t in enumerate(trees) if t.moved}
    if not moved:
        return
    spec = s | {"level": max(max(t.moved.values()) for t in moved.values()),
                "trees": {i: t.route(np.array(sorted(t.moved))) for i, t in moved.items()}}
    groups = sum(len(t.moved) for t in moved.values())
    size = sum(float(t.weight[list(t.moved)].sum()) for t in moved.values()) * row_bytes
    parts = max(min(groups, 3 * blocks.sparkSession.sparkContext.defaultParallelism), math.ceil(size / TASK_BYTES))
    grown = s | {"levels": {i: t.moved for i, t in moved.items()}}
    rows = blocks.mapInArrow(lambda it: _moved(it, spec), "tree int, node int, codes binary, y binary, w binary, bag binary")
    for r in rows.repartition(parts, "tree", "node").groupBy("tree", "node").applyInArrow(
            lambda table: _grown(table, grown), "tree int, node int, " + ", ".join(f"{c} binary" for c in _NODE)).collect():
        t, node = trees[r["tree"]], r["node"]
        got = {c: np.frombuffer(r[c]) for c in _NODE}
        count = len(got["bags"])
        at = t.add(count - 1)
        where = np.concatenate([[node], np.arange(at, at + count - 1)])
        inner = got["left"] >= 0
        t.totals[where], t.bags[where] = got["totals"].reshape(count, -1), got["bags"]
        t.feature[where[inner]], t.code[where[inner]], t.gain[where[inner]] = (got[c][inner] for c in ("feature", "code", "gain"))
        t.left[where[inner]] = got["left"][inner].astype(np.int64) + at - 1


# ---------------------------------------------------------------- Spark's model

def _node_columns(t: _Tree, thresholds, shift: float, classes: int) -> dict:
    """A tree's nodes as Spark stores them: sibling leaves of one prediction merged, children numbered after their parents."""
    count = len(t.feature)
    n = t.totals.sum(1) if classes else t.totals[:, 0]
    with np.errstate(all="ignore"):
        if classes:
            prediction, stats = t.totals.argmax(1).astype(float), t.totals
            impurity = np.where(n > 0, 1 - ((t.totals / n[:, None]) ** 2).sum(1), 0.0)
        else:
            mean = np.where(n > 0, t.totals[:, 1] / n, 0.0)
            prediction, impurity = mean + shift, np.where(n > 0, np.maximum(t.totals[:, 2] / n - mean * mean, 0.0), 0.0)
            stats = np.stack([n, t.totals[:, 1] + shift * n, t.totals[:, 2] + 2 * shift * t.totals[:, 1] + shift * shift * n], axis=1)
    left, guess = t.left.tolist(), prediction.tolist()
    leaf = (t.left == np.arange(count)).tolist()
    for i in range(count - 1, -1, -1):
        if not leaf[i]:
            a = left[i]
            if leaf[a] and leaf[a + 1] and guess[a] == guess[a + 1]:
                leaf[i], guess[i] = True, guess[a]
    kept = [False] * count
    kept[0] = True
    for i in range(count):
        if kept[i] and not leaf[i]:
            kept[left[i]] = kept[left[i] + 1] = True
    kept, leaf = np.array(kept), np.array(leaf)
    place = np.cumsum(kept) - 1
    inner = kept & ~leaf
    child = np.full(count, -1)
    child[inner] = place[t.left[inner]]
    other = np.full(count, -1)
    other[inner] = place[t.left[inner] + 1]
    value = np.array([thresholds[f][c] if i else 0.0 for f, c, i in zip(t.feature.tolist(), t.code.tolist(), inner.tolist())])
    return {"prediction": np.array(guess)[kept], "impurity": impurity[kept], "stats": stats[kept], "bags": np.rint(t.bags[kept]),
            "gain": np.where(inner, t.gain, -1.0)[kept], "left": child[kept], "right": other[kept],
            "feature": np.where(inner, t.feature, -1)[kept], "value": value[kept], "inner": inner[kept]}


def _spark_model(est, trees: list[_Tree], thresholds, shift: float, s: dict, spark):
    """The trees as Spark ML's model: the files of a forest fitted on two rows a class, with these nodes in place of its own."""
    import pyarrow as pa
    classes = s["classes"]
    labels = [float(c) for c in range(classes or 1)]
    one = spark.createDataFrame([([0.0] * s["width"], c, 1.0) for c in labels * 2], "f array<double>, y double, w double") \
        .select(array_to_vector("f").alias(est.getFeaturesCol()), F.col("y").alias(est.getLabelCol()),
                *([F.col("w").alias(est.getWeightCol())] if est.isSet("weightCol") and est.getWeightCol() else []))
    stub = est.fit(one)
    path = f"{checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    stub.save(path)
    columns = [_node_columns(t, thresholds, shift, classes) for t in trees]
    sizes = [len(c["gain"]) for c in columns]
    every = {c: np.concatenate([x[c] for x in columns]) for c in columns[0]}

    def ints(v):
        return pa.array(v.astype(np.int32))

    def lists(values, ends):
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))
    inner = every["inner"]
    split = pa.StructArray.from_arrays([ints(every["feature"]), lists(every["value"][inner], np.cumsum(inner)), ints(np.full(len(inner), -1))],
                                       names=["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    stats = every["stats"]
    nodes = pa.StructArray.from_arrays(
        [ints(np.concatenate([np.arange(k) for k in sizes])), pa.array(every["prediction"]), pa.array(every["impurity"]),
         lists(stats.ravel(), np.arange(1, len(stats) + 1) * stats.shape[1]), pa.array(every["bags"].astype(np.int64)), pa.array(every["gain"]),
         ints(every["left"]), ints(every["right"]), split],
        names=["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    table = pa.table({"treeID": ints(np.repeat(np.arange(len(trees)), sizes)), "nodeData": nodes})
    spark.createDataFrame(table).write.mode("overwrite").parquet(f"{path}/data")
    model = type(stub).load(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return model
