"""N-gram Jaccard join: exact metric-space join of documents on their word shingles (operator 10).

The Jaccard distance ``1 - |x & y| / |x | y|`` is a metric. Documents without a common shingle are all at
distance 1, where document pivots tell nothing, so the outermost pivots are single shingles: a document's
regions are those of its first ``n - ceil(t*n) + 1`` shingles in one global order, and two sets above
the threshold ``t`` meet in at least one of them. The order puts shingles that a bounded sample of documents shows
often last (any order gives the same result; this one keeps licence lines from making large regions).

1. One scan gives each document its set's digest, size, first shingles and class counts. Equal sets become
   one node.
2. Per region, triangle inequality: the class counts are coordinates that change by at most one per shingle
   added or removed, so their L1 distance bounds ``|x ^ y|`` from below, as do the sizes. What survives gives a
   spanning forest per region, never its pairs; regions of more than ``BLOCK`` rows run as pairs of blocks.
3. The forests' components are the inner regions, which join exactly on whole sets: document pivots
   make Voronoi cells, a document is replicated into every cell within ``2 * eps`` of its own, and
   cells join recursively (``link_sets``). They too run as pairs of blocks beyond ``BLOCK_SHINGLES``.
4. Components of the links, by distributed star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import buffers, distinct, mix, pieces, shingles
from .common import connected_components, stash, workers

#: Documents whose shingles are counted for the global order, and the most frequent shingles kept.
ORDER_SAMPLE, ORDER_KEPT = 8_000, 1 << 17
#: Rows of a region, and shingles of a cluster, in a block; a task joins two blocks at once.
BLOCK, BLOCK_SHINGLES = 4096, 3 << 20
#: Class counts of a small set; larger ones have one class for 8 to 16 shingles, so that unrelated sets differ in most.
CLASSES, CLASSES_MOST = 64, 4096
_U = np.uint64


def digest(h: np.ndarray) -> int:
    """64-bit digest of a sorted set of hashes, as a signed integer."""
    if not len(h):
        return 0
    x = (mix(h) * (np.arange(len(h), dtype=_U) * _U(2) + _U(0x9E3779B97F4A7C15))).sum(dtype=_U)
    return int(mix(np.array([x ^ _U(len(h))], _U)).view(np.int64)[0])


def class_counts(h: np.ndarray) -> np.ndarray:
    """Numbers of members by class, a power of two of them; a count above 255 stays there."""
    c = CLASSES
    while c < CLASSES_MOST and 16 * c < len(h):
        c *= 2
    return np.minimum(np.bincount((h & _U(c - 1)).astype(np.int64), minlength=c), 255).astype(np.uint8)


def folded(classes: np.ndarray, c: int = CLASSES) -> np.ndarray:
    """The counts as c classes, no more than there are."""
    if len(classes) == c:
        return classes
    return np.minimum(classes.reshape(-1, c).sum(axis=0, dtype=np.int64), 255).astype(np.uint8)


def prefix_length(n: int, num: int, den: int) -> int:
    """Shingles among which a set of n meets every set at least num/den similar."""
    return n - (-(-num * n // den)) + 1 if n else 0


def _scan(k: int, num: int, den: int, often):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_often, rank_often = often.value
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            n, dig, first, classes = [], [], [], []
            for _, _, r, o in pieces(raw, off):
                for h in shingles(r, o, k):
                    n.append(len(h))
                    dig.append(digest(h))
                    classes.append(class_counts(h).tobytes())
                    p = prefix_length(len(h), num, den)
                    if len(keys_often) and p:
                        at = np.minimum(np.searchsorted(keys_often, h), len(keys_often) - 1)
                        rank = np.where(keys_often[at] == h, rank_often[at], 0)
                        # h is sorted, so a stable sort by rank orders by (rank, hash)
                        h = h[np.argsort(rank, kind="stable")[:p]]
                    first.append(h[:p].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in first])]).astype(np.int32)
            flat = np.concatenate(first) if first else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(dig, pa.int64()),
                 pa.array(classes, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["doc_id", "th", "n", "node", "classes", "keys"])
    return run


def _sample_shingles(k: int):
    def run(batches):
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            for _, _, r, o in pieces(raw, off):
                got = shingles(r, o, k)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64))], names=["h"])
    return run


def _frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a bounded sample share, with their counts."""
    n = docs.count()
    share = min(1.0, ORDER_SAMPLE / max(n, 1))
    some = (docs.where(F.pmod(F.xxhash64("th", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)))
            .dropDuplicates(["th"]).select("text"))
    rows = (some.mapInArrow(_sample_shingles(k), "h long").groupBy("h").count().where("count >= 3")
            .orderBy(F.desc("count"), "h").limit(ORDER_KEPT).collect())
    keys = np.array([r[0] for r in rows], np.int64).view(_U)
    order = np.argsort(keys)
    return keys[order], np.array([r[1] for r in rows], np.int64)[order]


def _in_blocks(df: DataFrame, size: str, block: int, node: str) -> DataFrame:
    """Rows dealt to work units: the group itself, or each pair of blocks of a group whose size is above a block's."""
    nb = F.ceil(F.col(size) / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64(F.col(node), F.lit(5)), F.col("nb").cast("bigint")).cast("int")
    unit = F.when(F.col("nb") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: o != F.col("mine")),
                    lambda o: F.least(o, F.col("mine")).cast("long") * F.col("nb") + F.greatest(o, F.col("mine"))))
    return (df.withColumn("nb", nb).withColumn("mine", mine).withColumn("unit", F.explode(unit))
            .drop("nb", "mine", size))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows of sorted keys, with the end."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def forest(nodes: np.ndarray, size: np.ndarray, coarse: np.ndarray, fine: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Spanning forest of the rows of a region that the bounds can't tell apart."""
    left = np.argsort(size, kind="stable")
    out = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = left[_possible(size[x], size[left], coarse[x], coarse[left], num, den)]
            near = near[[_still(size[x], size[y], fine[x], fine[y], num, den) for y in near]] if len(near) else near
            if len(near):
                out += [(nodes[x], nodes[y]) for y in near]
                queue += list(near)
                left = left[~np.isin(left, near)]
    return out


def _possible(sx, sy, cx, cy, num, den) -> np.ndarray:
    """False only where the similarity is surely below num/den: |x ^ y| <= (1-t)/(1+t) * (|x| + |y|)."""
    d = np.abs(cx.astype(np.int16) - cy.astype(np.int16)).sum(axis=-1, dtype=np.int64)
    return (den + num) * np.maximum(d, np.abs(sx - sy)) <= (den - num) * (sx + sy)


def _still(sx, sy, cx, cy, num, den) -> bool:
    """The same bound on all the classes that both have."""
    c = min(len(cx), len(cy))
    return c == CLASSES or bool(_possible(sx, sy, folded(cx, c), folded(cy, c), num, den))


def _region_links(num: int, den: int):
    def run(batches):
        for batch in _whole(batches, ["key", "unit"]):
            key, unit = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "unit"))
            node, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n"))
            fine = [np.frombuffer(c, np.uint8) for c in batch.column("classes").to_pylist()]
            classes = np.stack([folded(c) for c in fine])
            runs = _runs(key, unit)
            ok = np.zeros(len(key), bool)
            for i in range(1, len(key), 65536):
                j = min(len(key), i + 65536)
                ok[i:j] = _possible(size[i - 1:j - 1], size[i:j], classes[i - 1:j - 1], classes[i:j], num, den)
            ok[runs[:-1]] = False
            for i in np.flatnonzero(ok):
                ok[i] = _still(size[i - 1], size[i], fine[i - 1], fine[i], num, den)
            ok[runs[:-1]] = True
            bad = np.add.reduceat((~ok).astype(np.int64), runs[:-1]) if len(key) else np.zeros(0, np.int64)
            chained = np.repeat(bad == 0, np.diff(runs))
            chained[runs[:-1]] = False
            at = np.flatnonzero(chained)
            a, b = [node[at - 1]], [node[at]]
            for r in np.flatnonzero(bad):
                i, j = runs[r], runs[r + 1]
                got = forest(node[i:j], size[i:j], classes[i:j], fine[i:j], num, den)
                if got:
                    g = np.array(got, np.int64)
                    a.append(g[:, 0])
                    b.append(g[:, 1])
            a, b = np.concatenate(a), np.concatenate(b)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
    return run


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut anew so that no group of equal keys spans two of them."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        cols = [held.column(c) for c in keys]
        cut = held.num_rows - 1
        last = [c[cut].as_py() for c in cols]
        while cut > 0 and all(c[cut - 1].as_py() == v for c, v in zip(cols, last)):
            cut -= 1
        if cut:
            yield held.slice(0, cut).combine_chunks().to_batches()[0]
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks().to_batches()[0]


# -- the exact join of one inner region ------------------------------------------------------------------

class _Sets:
    """Sets as rows of member numbers, for exact intersections of one set with many."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        vocabulary = distinct(np.concatenate(sets)) if sets else np.zeros(0, _U)
        self.rows = [np.searchsorted(vocabulary, s).astype(np.int32) for s in sets]
        self.mark = np.zeros(len(vocabulary), np.uint8)

    def together(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of some sets, none of which is empty, as one array with their lengths."""
        return np.concatenate([self.rows[y] for y in at]), self.size[at]

    def shared(self, x: int, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of x with those sets."""
        self.mark[self.rows[x]] = 1
        got = np.add.reduceat(self.mark[flat], np.concatenate([[0], np.cumsum(lengths)[:-1]]), dtype=np.int64)
        self.mark[self.rows[x]] = 0
        return got

    def distances(self, x: int, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        both = self.shared(x, flat, lengths)
        return 1.0 - both / (self.size[x] + lengths - both)


def link_sets(sets: list[np.ndarray], num: int, den: int, leaf: int = 48, pivots: int = 8) -> list[tuple[int, int]]:
    """Links that span exactly the components of the graph of pairs with similarity >= num/den."""
    s, eps = _Sets(sets), 1.0 - num / den
    out: list[tuple[int, int]] = []

    def flood(at: np.ndarray) -> None:
        flat, lengths = s.together(at)
        queue: list[int] = []
        while len(at):
            if not queue:
                queue.append(int(at[0]))
                flat, lengths, at = flat[lengths[0]:], lengths[1:], at[1:]
                continue
            x = queue.pop()
            both = s.shared(x, flat, lengths)
            near = den * both >= num * (s.size[x] + lengths - both)
            if near.any():
                out.extend((x, int(y)) for y in at[near])
                queue += [int(y) for y in at[near]]
                flat, lengths, at = flat[np.repeat(~near, lengths)], lengths[~near], at[~near]

    def cells_of(at: np.ndarray) -> list[np.ndarray]:
        flat, lengths = s.together(at)
        chosen, to = [int(at[0])], [s.distances(int(at[0]), flat, lengths)]
        while len(chosen) < pivots:
            nearest = np.min(to, axis=0)
            far = int(np.argmax(nearest))
            if nearest[far] <= eps:
                break
            chosen.append(int(at[far]))
            to.append(s.distances(int(at[far]), flat, lengths))
        d = np.array(to)
        # replicate to every cell that a neighbour within eps may call home
        return [at[d[i] <= d.min(axis=0) + 2 * eps + 1e-9] for i in range(len(chosen))
                if (d.argmin(axis=0) == i).any()]

    # a list instead of calls: where cells peel a few sets off a region, it is divided more often than calls may nest
    regions = [some] if len(some := np.flatnonzero(s.size > 0)) else []
    while regions:
        at = regions.pop()
        if len(at) <= leaf:
            flood(at)
            continue
        cells = cells_of(at)
        sizes = [len(c) for c in cells]
        # where the windows cover most of the region, cells would repeat its work instead of dividing it; below the
        # square of the region's size every cell is smaller than it, and all cells of cells cost no more than a flood
        if sum(sizes) > 1.25 * len(at) or sum(n * n for n in sizes) >= len(at) ** 2:
            flood(at)
        else:
            regions += cells
    return out


def _cluster_links(k: int, num: int, den: int):
    def one(nodes, sets):
        return [(nodes[i], nodes[j]) for i, j in link_sets(sets, num, den)]

    def run(batches):
        now, nodes, sets = None, [], []
        for batch in batches:
            cluster, unit, node = (batch.column(c).to_pylist() for c in ("cluster", "unit", "node"))
            raw, off = buffers(batch.column("text"))
            got = (h for _, _, r, o in pieces(raw, off) for h in shingles(r, o, k))
            edges = []
            for c, u, x, h in zip(cluster, unit, node, got):
                if (c, u) != now:
                    edges += one(nodes, sets)
                    now, nodes, sets = (c, u), [], []
                nodes.append(x)
                sets.append(h)
            yield _edges(edges)
        yield _edges(one(nodes, sets))
    return run


def _edges(edges) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()),
                                       pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])


def jaccard_groups(documents: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, th, grp) for every row: components of the documents linked at num/den.

    ``th`` is the xxhash64 of the text, which with doc_id names the row, and ``grp`` a number of the component, NULL
    for texts without words. Equal sets are linked. NULL and empty
    texts have no shingles and stay alone, their component being their own id. Rows with a NULL doc_id are
    linked like others and are only left out of the smallest id (NULL if no other is there); repeated
    rows are equal sets. Other columns are ignored; an empty table gives no rows.
    """
    spark = documents.sparkSession
    workers(spark)
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    often = spark.sparkContext.broadcast(_frequent(docs, k))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = stash(docs.mapInArrow(_scan(k, num, den, often),
                                 f"doc_id {id_type}, th long, n long, node long, classes binary, keys array<long>"))

    nodes = (rows.where("n > 0").groupBy("node")
             .agg(F.min(F.struct("doc_id", "th", "n", "classes", "keys")).alias("r")).select("node", "r.*"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    visits = nodes.select("node", F.explode("keys").alias("key")).repartition(parts, "key")
    shared = visits.groupBy("key").agg(F.count("*").alias("c")).where("c >= 2")
    visits = visits.join(shared, "key")
    about = rows.where("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.min("classes").alias("classes"))
    region = _in_blocks(visits.join(about, "node"), "c", BLOCK, "node")
    maybe = (region.repartition(parts, "key", "unit").sortWithinPartitions("key", "unit", "n", "node")
             .mapInArrow(_region_links(num, den), "a long, b long"))
    clusters = connected_components(maybe).withColumnsRenamed({"component": "cluster"})
    place = rows.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "th", "n")).alias("r"))
    clusters = stash(clusters.join(place, "node"))
    # written, so that the join with a hot cluster's rows can be split
    sizes = stash(clusters.groupBy("cluster").agg(F.sum("r.n").alias("c")))
    members = clusters.join(sizes, "cluster").select(
        "cluster", "c", "node", F.col("r.doc_id").alias("rid"), F.col("r.th").alias("rth"))
    texts = (docs.join(members, docs.doc_id.eqNullSafe(members.rid) & (docs.th == members.rth))
             .select("cluster", "c", "node", "text"))
    work = _in_blocks(texts, "c", BLOCK_SHINGLES, "node")
    links = (work.repartition(parts, "cluster", "unit").sortWithinPartitions("cluster", "unit", "node")
             .mapInArrow(_cluster_links(k, num, den), "a long, b long"))
    found = connected_components(links)
    # components are named node by node; the documents, many of which may share a node, come last
    named = stash(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("low")).join(found, "node", "left")
                  .select("node", "low", F.coalesce("component", "node").alias("grp")))
    lowest = stash(named.groupBy("grp").agg(F.min("low").alias("component_id")))
    named = named.join(lowest, "grp").select("node", "grp", "component_id")
    full = rows.select("doc_id", "th", "n", "node").where("n > 0").join(named, "node")
    return (full.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "th", "grp")
            .unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
                                                    "th", F.lit(None).cast("long").alias("grp"))))
