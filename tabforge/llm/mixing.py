"""Mixing overlapping sources to target weights by min-cost flow (operator 8).

Documents are aggregated by membership pattern, the set of sources that a document belongs to. A flow routes each
pattern's words to the quotas of its sources; a pattern's first words cost nothing, those of a second time
something, so repeats are used only where the quotas need them (convex costs). Sources that share a pattern form a component of
the pattern-source graph. No flow crosses components, so each is solved in its own task; neither sources nor
patterns are gathered on the driver. What a pattern gives is then selected in a seeded
order: a histogram of the order's hash, refined only around the cut, finds it without sorting or
gathering a source, however large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabforge.operators.components import components

from .common import stash, workers

WEIGHTS = (5, 2, 1)
SHARE, REPEAT = 1.5, 2
SEED = 42
#: Bits of the order's hash that a round of the histogram looks at.
WIDTH = 12


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Targets of the sources: weights 5, 2, 1 in turn by code point, NULL last; 150 % of all words are
    shared, and what a source has beyond twice its words is shared again among the others."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    left, open_ = SHARE * sum(sizes.values()), list(names)
    while open_:
        per = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if per * weight[s] > REPEAT * sizes[s]]
        if not over:
            out |= {s: per * weight[s] for s in open_}
            break
        for s in over:
            out[s] = float(REPEAT * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in over]
    return {s: out[s] for s in names}


def route(patterns: list[tuple[tuple, int]], quota: dict) -> list[dict]:
    """Words that each pattern gives to each of its sources: a flow of least cost among the largest ones.

    The n-th use of a pattern's words costs n - 1 a word. Costs stand only on the edges into the patterns, so the flow of least
    cost is found use by use: the edges of one more use are added, and the flow is made as large as it gets by
    blocking flows on shortest ways (levels from the start, then ways along them until none is left).
    """
    n, names = len(patterns), list(quota)
    start, end = n + len(names), n + len(names) + 1
    graph: list[list[int]] = [[] for _ in range(end + 1)]
    to, room = [], []

    def edge(a, b, c):
        for x, y, r in ((a, b, c), (b, a, 0)):
            graph[x].append(len(to))
            to.append(y)
            room.append(r)
    where = {s: n + i for i, s in enumerate(names)}
    gives = []
    for i, (members, size) in enumerate(patterns):
        gives.append({})
        for s in members:
            gives[i][s] = len(to)
            edge(i, where[s], REPEAT * size)
    for s in names:
        edge(where[s], end, quota[s])
    for _ in range(REPEAT):
        for i, (_, size) in enumerate(patterns):
            edge(start, i, size)
        while True:
            level, at = {start: 0}, [start]
            for x in at:
                for e in graph[x]:
                    if room[e] > 0 and to[e] not in level:
                        level[to[e]] = level[x] + 1
                        at.append(to[e])
            if end not in level:
                break
            tried, path, x = [0] * len(graph), [], start
            while True:
                if x == end:
                    flow = min(room[e] for e in path)
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    # back to before the first edge that is full
                    full = next(i for i, e in enumerate(path) if not room[e])
                    x = to[path[full] ^ 1]
                    del path[full:]
                elif tried[x] < len(graph[x]):
                    e = graph[x][tried[x]]
                    if room[e] > 0 and level.get(to[e]) == level[x] + 1:
                        path.append(e)
                        x = to[e]
                    else:
                        tried[x] += 1
                elif path:
                    # a dead end: the edge that led here is of no use on this level
                    x = to[path.pop() ^ 1]
                    tried[x] += 1
                else:
                    break
    return [{s: room[e ^ 1] for s, e in g.items()} for g in gives]


def _cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """For each (pattern, words) the order's value at which its running sum reaches the words:
    (pattern, cut, words before it, words tied at it)."""
    want = stash(cuts.select("pattern", F.lit(0).cast("long").alias("prefix"), F.col("words").alias("rest"), F.lit(0).cast("long").alias("b0")))
    out, level = [], 0
    while not out or not want.isEmpty():
        shift = max(0, 60 - WIDTH * (level + 1))
        # rows of the open buckets only
        near = rows.select("pattern", "at", "size").join(want, "pattern").where(
            F.shiftright("at", 60 - WIDTH * level) == F.col("prefix") if level else F.lit(True))
        steps = near.groupBy("pattern", F.shiftright("at", shift).alias("step")).agg(
            F.sum("size").alias("words"), F.countDistinct("at").alias("values") if level else F.lit(2).cast("long").alias("values"),
            F.min("at").alias("at"), F.first("rest").alias("rest"), F.first("b0").alias("b0"))
        run = Window.partitionBy("pattern").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hit = stash(steps.withColumn("upto", F.sum("words").over(run)).where("upto > rest and upto - words <= rest"))
        found = F.col("values") == 1 if shift else F.lit(True)
        before = F.col("b0") + F.col("upto") - F.col("words")
        out.append(hit.where(found).select("pattern", F.col("at").alias("cut"), before.alias("before"), F.col("words").alias("tied")))
        want = hit.where(~found).select("pattern", F.col("step").alias("prefix"), (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"),
                                        before.alias("b0"))
        level += 1
    return reduce(DataFrame.unionByName, out)


def _ranked(sizes: DataFrame) -> DataFrame:
    """The sources with their place by code point, NULL last: ranges of them, and the rows of the ranges before."""
    parts = sizes.sparkSession.sparkContext.defaultParallelism
    order = F.asc_nulls_last("source")
    placed = stash(sizes.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("id", F.monotonically_increasing_id())
                   .select("*", F.shiftright("id", 33).cast("int").alias("part"), F.col("id").bitwiseAND((1 << 33) - 1).alias("row")).drop("id"))
    counts = sorted(tuple(r) for r in placed.groupBy("part").count().collect())
    first = [(p, sum(n for _, n in counts[:i])) for i, (p, _) in enumerate(counts)]
    known = sizes.sparkSession.createDataFrame(first, "part int, before long")
    return placed.join(F.broadcast(known), "part").withColumn("place", F.col("row") + F.col("before")).drop("part", "row", "before")


def _goals(sizes: DataFrame) -> DataFrame:
    """(key, source_size, target, quota) of the sources (key, source, size): ``targets`` on a table of any number of sources."""
    sizes = _ranked(sizes)
    turn = F.pmod("place", F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), turn.cast("int") + 1)
    sizes = stash(sizes.select("key", "size", weight.alias("weight")))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    # what one weight gets only grows, so a source that has twice its words keeps that
    per, open_ = 0.0, None
    while True:
        over = F.lit(per) * F.col("weight") > REPEAT * F.col("size")
        n, weights, given = sizes.agg(F.count_if(~over), F.sum(F.when(~over, F.col("weight"))),
                                      F.sum(F.when(over, REPEAT * F.col("size")))).first()
        if not n or n == open_:
            break
        open_, per = n, max(per, (SHARE * total - (given or 0)) / weights)
    target = F.when(over, REPEAT * F.col("size")).otherwise(F.lit(per) * F.col("weight")).cast("double")
    return sizes.select("key", F.col("size").alias("source_size"), target.alias("target")).withColumn("quota", F.bround("target").cast("long"))


def _routed(of, pdf):
    """The flow of one component: its patterns with the words that they give."""
    import pandas as pd
    each = pdf.sort_values(["pattern", "key"], kind="stable")
    quota = dict(zip(each["key"].tolist(), each["quota"].tolist()))
    patterns, size = {}, {}
    for p, k, n in zip(each["pattern"].tolist(), each["key"].tolist(), each["size"].tolist()):
        patterns.setdefault(p, []).append(k)
        size[p] = n
    flows = route([(tuple(m), size[p]) for p, m in patterns.items()], quota)
    return pd.DataFrame({"pattern": list(patterns), "size": [size[p] for p in patterns], "give": [sum(f.values()) for f in flows]})


def _gives(edges: DataFrame, goals: DataFrame) -> DataFrame:
    """(pattern, size, give) by the flow, where ``edges`` are (pattern, key, size, first): a pattern's sources, one of which is its first."""
    workers(edges.sparkSession)
    # sources of one pattern are one component; a source that shares none is its own
    linked = components(edges.where("key <> first").select("first", "key"), "first", "key")
    whole = (edges.join(goals.select("key", "quota"), "key").join(linked, F.col("first") == F.col("node"), "left")
             .select("pattern", "key", "size", "quota", F.coalesce("component", "first").alias("of")))
    return whole.groupBy("of").applyInPandas(_routed, "pattern string, size long, give long")


def mix(documents: DataFrame, members: str | None = None) -> DataFrame:
    """(doc_id, source, th, size, source_size, target, taken) of every row.

    ``members`` names an array column of the sources that a row belongs to; without it that is its own
    source alone. ``taken`` is the number of words that the mix takes: whole documents in a seeded order, at most
    twice; the one at the cut gives the words that are still missing, shared among rows with the same id and text.
    NULL texts have size 0 and a NULL source is a source, the last. Rows are ordered by a hash of
    id and text, so reruns and other partitionings agree; an empty table gives no rows. Rows whose ``members`` are NULL or
    empty belong to no source and nothing of them is taken; ``source_size`` and ``target`` are those of the row's own source, NULL
    where no row's members name it.
    """
    text = F.coalesce("text", F.lit(""))
    at = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", text), 4)
    named = {"ignoreNullFields": "false"}
    rows = stash(documents.select(
        "doc_id", "source", F.xxhash64("text").alias("th"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("size"), at.alias("at"),
        F.array_sort(F.array_distinct(F.col(members)) if members else F.array("source")).alias("members"))
        .withColumn("pattern", F.to_json(F.struct("members"), named))
        .withColumn("key", F.to_json(F.struct("source"), named)))
    sums = stash(rows.groupBy("pattern", "key").agg(F.sum("size").alias("size"), F.first("members").alias("members")))
    patterns = sums.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("members").alias("members"))
    edges = stash(patterns.select("pattern", "size", F.get("members", F.lit(0)).alias("one"), F.explode("members").alias("source")).select(
        "pattern", "size", "source", F.to_json(F.struct("source"), named).alias("key"),
        F.to_json(F.struct(F.col("one").alias("source")), named).alias("first")))
    goals = stash(_goals(edges.groupBy("key").agg(F.sum("size").alias("size"), F.first("source").alias("source"))))
    whole = F.when(F.col("size") > 0, F.expr("give div size")).otherwise(F.lit(0).cast("long"))
    given = stash(_gives(edges, goals).withColumn("whole", whole).withColumn("words", F.col("give") - F.col("whole") * F.col("size")))
    cuts = _cuts(rows, given.where("size > 0 and words > 0"))
    # written, so that it is broadcast where it is small, and a join with a hot source's rows can be split elsewhere
    plan = stash(sums.select("pattern", "key").join(given.drop("size", "give"), "pattern", "left").join(cuts, "pattern", "left")
                 .join(goals.drop("quota"), "key", "left"))
    part = (F.when(F.col("at") < F.col("cut"), F.col("size"))
            .when(F.col("at") == F.col("cut"), F.expr("((words - before) * size) div tied")).otherwise(F.lit(0)))
    return rows.join(plan, ["pattern", "key"]).select(
        "doc_id", "source", "th", "size", "source_size", "target",
        (F.coalesce("whole", F.lit(0)) * F.col("size") + part).cast("long").alias("taken"))
