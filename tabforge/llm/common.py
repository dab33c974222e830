"""Shared helpers: reading tables, written intermediate tables, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.session import checkpoint_dir, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark (any file system that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Stash:
    """A written table in the shared checkpoint folder: cuts lineage and survives lost executors.

    Unlike ``checkpoint()`` it evaluates the plan once. The files go when ``drop()`` is called, or
    else when the application ends.
    """

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        path = f"{checkpoint_dir(spark)}/stash-{uuid.uuid4().hex}"
        df.write.parquet(path)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path)
        self.df = spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        self._fs.delete(self._path, True)


def stash(df: DataFrame) -> DataFrame:
    """The table written once to the shared folder and read again."""
    return Stash(df).df


def aside(df: DataFrame, names: list[str]):
    """(df, back): the table with its columns of those names, if any, under free ones, and a function that gives a result their names again."""
    used, free = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            new = f"{c}_aside"
            while new.lower() in used:
                new += "_"
            used.add(new.lower())
            free[c] = new
    if not free:
        return df, lambda got: got
    return df.withColumnsRenamed(free), lambda got: got.withColumnsRenamed({new: c for c, new in free.items()})


def workers(spark: SparkSession) -> None:
    """Make this package importable in the Python workers."""
    ship_package(spark)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that stands on an edge.

    Alternating large-star and small-star rounds; each is two aggregates with partial results, whose small results are
    written, and two joins of the edges with them, which adaptive execution splits where a node is hot (it
    can't where a side is an aggregate of the same shuffle), so a hub with a third of all edges is never gathered
    in one task. Every round is a written table; the loop ends when a round changes nothing, after
    about log(n) rounds whatever the length of the chains. NULL ends and loops are dropped.
    """
    now = Stash(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                .where("u is not null and v is not null and u <> v").distinct())
    mark = None
    while True:
        e = now.df
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = Stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = Stash(both.join(low.df, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .where("u <> v").distinct())
        least = Stash(large.df.groupBy("u").agg(F.min("v").alias("m")))
        small = (large.df.join(least.df, "u")
                 .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.*").where("u <> v").distinct())
        after = Stash(small)
        got = after.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in (now, low, large, least):
            old.drop()
        now = after
        if got == mark:
            break
        mark = got
    star = now.df
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        star.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def row_key() -> F.Column:
    """The share of the string doc_id that decides folds: crc32 of its text, NULL as empty."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
