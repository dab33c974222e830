"""Embedding near-dedup: random-hyperplane sign hashing, exact cosine, connected components (operator 6).

Equal vectors are one node with a count. Each node gets a key of ``bits`` signs in every one of several tables; the
bits grow with the logarithm of the rows, so buckets stay small, and the tables are as many as find
a pair exactly at the threshold with probability ``RECALL`` (closer pairs more surely). Within a bucket all cosines
are computed in double precision, block by block; a pair counts in the first table that joins it. A bucket
gives a count a node and a spanning forest of its links, never pairs; buckets of more than ``BLOCK`` nodes run as pairs
of blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, stash, workers
from .jaccard import _runs, _whole

RECALL = 0.999
BUCKET, BLOCK, SEED = 64, 1024, 13


def tables(n: int, threshold: float) -> tuple[int, int]:
    """(bits, tables) for n rows."""
    bits = min(60, max(4, math.ceil(math.log2(max(n, 1) / BUCKET))) if n > BUCKET else 4)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - same))


def planes(dim: int, bits: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).normal(size=(dim, bits * count))


def _matrix(col) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)


def _signs(bits: int, count: int):
    place = (np.int64(1) << np.arange(bits, dtype=np.int64))
    cache: dict[int, np.ndarray] = {}

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            keys = np.zeros((len(dims), count), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = _matrix(batch.column("vec").take(pa.array(at)))
                if int(d) not in cache:
                    cache[int(d)] = planes(int(d), bits, count)
                for i in range(0, len(at), 2048):
                    s = x[i:i + 2048] @ cache[int(d)] > 0
                    keys[at[i:i + 2048]] = s.reshape(-1, count, bits) @ place
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("node", "copies", "dim", "vec")] + [pa.array(list(keys), pa.list_(pa.int64()))],
                names=["node", "copies", "dim", "vec", "keys"])
    return run


def _components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _links(threshold: float):
    def run(batches):
        for batch in _whole(batches, ["t", "key", "dim", "unit"]):
            t, key, dim, unit = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "key", "dim", "unit"))
            node, copies, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "copies", "block"))
            runs = _runs(t, key, dim, unit)
            out = []
            for a, b in zip(runs[:-1], runs[1:]):
                if b - a < 2:
                    continue
                x = _matrix(batch.column("vec").slice(a, b - a))
                keys = batch.column("keys").slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)[:, :t[a]]
                x = x / np.sqrt((x * x).sum(axis=1))[:, None]
                left, right = np.flatnonzero(block[a:b] == block[a]), np.flatnonzero(block[a:b] != block[a])
                cross = len(right) > 0
                i, j = np.nonzero(x[left] @ x[right if cross else left].T >= threshold)
                i, j = left[i], (right if cross else left)[j]
                if not cross:
                    i, j = i[i < j], j[i < j]
                if t[a] and len(i):
                    new = np.concatenate([~(keys[i[s:s + 65536]] == keys[j[s:s + 65536]]).any(axis=1)
                                          for s in range(0, len(i), 65536)])
                    i, j = i[new], j[new]
                if len(i):
                    c = copies[a:b]
                    n = np.bincount(i, weights=c[j], minlength=b - a) + np.bincount(j, weights=c[i], minlength=b - a)
                    low = _components(b - a, i, j)
                    at = np.flatnonzero(n)
                    out.append((node[a:b][at], n[at].astype(np.int64), node[a:b][low[at]]))
            cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["node", "n", "low"])
    return run


def near_vectors(embeddings: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are NULL, empty, zero, or hold NULL or non-finite components link with nothing, and are their own component; so are
    those of other lengths to each other. Repeated rows are linked rows. A NULL vec_id links like others
    and is left out of the smallest id. Other columns are ignored; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    workers(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    fine = (F.coalesce(F.size("embedding") > 0, F.lit(False))
            & F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
            & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False)))
    rows = embeddings.select("vec_id", "embedding").withColumn("fine", fine)
    # -0.0 and 0.0 are one value
    vec = F.transform("embedding", lambda v: F.when(v == 0, F.abs(v)).otherwise(v))
    good = stash(rows.where("fine").withColumn("vec", vec).withColumn("node", F.xxhash64("vec")).select("vec_id", "node", "vec"))
    nodes = good.groupBy("node", "vec").agg(F.count("*").alias("copies")).withColumn("dim", F.size("vec"))
    lows = good.groupBy("node").agg(F.min("vec_id").alias("low"))
    bits, count = tables(good.count(), threshold)
    kind = good.schema["vec"].dataType.simpleString()
    signed = stash(nodes.mapInArrow(_signs(bits, count), f"node long, copies long, dim int, vec {kind}, keys array<long>"))
    visits = signed.select("*", F.posexplode("keys").alias("t", "key"))
    many = visits.groupBy("t", "key", "dim").agg(F.count("*").alias("m")).where("m >= 2")
    nb = F.ceil(F.col("m") / F.lit(BLOCK)).cast("long")
    units = (visits.join(many, ["t", "key", "dim"]).withColumn("nb", nb)
             .withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("nb")))
             .withColumn("unit", F.explode(F.transform(
                 F.sequence(F.lit(0).cast("long"), F.col("nb") - 1),
                 lambda o: F.least(o, F.col("block")) * F.col("nb") + F.greatest(o, F.col("block")))))
             .drop("m", "nb"))
    found = stash(units.repartition(parts, "t", "key", "dim", "unit").sortWithinPartitions("t", "key", "dim", "unit", "block", "node")
                  .mapInArrow(_links(threshold), "node long, n long, low long"))
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    group = connected_components(found, "node", "low").withColumnRenamed("node", "c_node")
    # links and components are told node by node; the rows, many of which may share a node, come last
    named = stash(signed.select("node", "copies").join(lows, "node")
                  .join(links.withColumnRenamed("node", "l_node"), F.col("node") == F.col("l_node"), "left")
                  .join(group, F.col("node") == F.col("c_node"), "left")
                  .select("node", "low", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                          F.coalesce("component", "node").alias("g")))
    # written, so that the join with a hot component's nodes can be split
    least = stash(named.groupBy("g").agg(F.min("low").alias("component_id")))
    full = good.select("vec_id", "node").join(named.join(least, "g").select("node", "n_links", "component_id"), "node")
    out = full.select("vec_id", "n_links", "component_id").unionByName(
        rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
