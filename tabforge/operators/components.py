"""Connected components of a table of links, for nodes of any orderable type."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabforge.session import Written, ship_package

#: Up to so many links, one task follows them all; more go through the rounds below, with the same result.
ONE_TASK_LINKS = 100_000


def _follow(batches):
    import pandas as pd
    top: dict = {}

    def root(x):
        way = []
        while top.setdefault(x, x) != x:
            way.append(x)
            x = top[x]
        for y in way:
            top[y] = x
        return x
    for pdf in batches:
        for x, y in zip(pdf["hi"].tolist(), pdf["lo"].tolist()):
            x, y = root(x), root(y)
            top[max(x, y)] = min(x, y)
    nodes = list(top)
    if nodes:
        yield pd.DataFrame({"node": pd.Series(nodes), "component": pd.Series([root(x) for x in nodes])})


def components(links: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(node, component) for each node on a link; the component is its smallest node.

    Every round links the neighbours of a node to the smallest of them: first only the larger ones, then the smaller ones and
    the node itself, so that a chain halves and no node gathers its neighbours in one task. A round is four written tables
    and ends the loop when the links no longer change. NULL ends and self links count for nothing.
    """
    now = Written(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
                  .where("hi is not null and lo is not null and hi <> lo").distinct())
    if now.df.count() <= one_task:
        ship_package(links.sparkSession)
        kind = now.df.schema["hi"].dataType.simpleString()
        return now.df.coalesce(1).mapInPandas(_follow, f"node {kind}, component {kind}")
    seen = None
    while True:
        ends = now.df.unionByName(now.df.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        first = Written(ends.groupBy("hi").agg(F.min("lo").alias("least")).select("hi", F.least("hi", "least").alias("least")))
        larger = Written(ends.join(first.df, "hi").where("lo > hi and lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo")).distinct())
        below = Written(larger.df.groupBy("hi").agg(F.min("lo").alias("least")))
        star = larger.df.join(below.df, "hi")
        after = Written(star.where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
                        .unionByName(below.df.select("hi", F.col("least").alias("lo"))).distinct())
        mark = after.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        for old in (now, first, larger, below):
            old.drop()
        now = after
        if mark == seen:
            break
        seen = mark
    roots = now.df.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.df.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
