"""URL rules by a sort-merge range join on reversed-host keys (operator 11, native).

The labels of a host, last first, each followed by a dot, make a key in which a host stands before all its subdomains and
nothing else stands between them; so a rule's host is an interval of keys, and a rule's path, behind the key
of its host, is an interval too. Intervals of prefixes lie within one another or apart. ``sweep`` sorts the ends of the
intervals and the points together and passes over them once: the running sum of starts and ends is the height of the stack of
active rules, and on each level of the stack stands the last interval that started there. Ranges of the order
are passed over by different tasks, and the stack at the start of each range is carried from those before it by a table
of one row for a range and level. One sweep finds the rule hosts above every URL, a second one the longest rule path under each.

Only distinct URLs are swept, so that a hot host or URL weighs one row, and ranges split within a host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash, stash

#: Rows of one range of a sweep.
RANGE_ROWS = 1 << 18
_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: F.Column) -> F.Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _A, _Z)


def url_path(url: F.Column) -> F.Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: F.Column) -> F.Column:
    """The labels, last first, each followed by a dot: ``b.a`` gives ``a.b.``."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def sweep(points: DataFrame, rules: DataFrame, range_rows: int = RANGE_ROWS, levels: bool = True) -> DataFrame:
    """The points with the rules whose prefix their key starts with: every column of ``points`` and ``rule``.

    ``points`` has a string ``key``; ``rules`` has a distinct string ``prefix`` and ``rule`` (any type). With ``levels`` a point comes once
    for each such rule, else only for the longest prefix. Points under no rule are left out. NULL keys match nothing.
    """
    spark = points.sparkSession
    cols = points.columns
    at = F.encode("prefix", "UTF-8")
    blank = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in cols]
    none = F.lit(None).cast(rules.schema["rule"].dataType).alias("rule")
    rules = rules.where("prefix is not null")
    # UTF-8 has no byte FF, so a prefix and FF stand behind all that starts with the prefix
    events = (points.where("key is not null").select(F.encode("key", "UTF-8").alias("_k"), F.lit(2).alias("_kind"), none, F.struct(*cols).alias("_p"))
              .unionByName(rules.select(at.alias("_k"), F.lit(1).alias("_kind"), "rule", F.struct(*blank).alias("_p")))
              .unionByName(rules.select(F.concat(at, F.unhex(F.lit("FF"))).alias("_k"), F.lit(0).alias("_kind"), none, F.struct(*blank).alias("_p"))))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-points.count() // range_rows))
    # written, so that the ranges stay as they are; equal keys part by the point itself
    ranged = Stash(events.withColumn("_t", F.xxhash64("_p")).repartitionByRange(n, "_k", "_kind", "_t").withColumn("_range", F.spark_partition_id()))
    ev = ranged.df.withColumn("_d", F.when(F.col("_kind") == 1, 1).when(F.col("_kind") == 0, -1).otherwise(0))
    order = Window.partitionBy("_range").orderBy("_k", "_kind", "_t")
    # the height each range starts with: one row for a range
    ranges = ev.groupBy("_range").agg(F.sum("_d").alias("_gain"))
    before = ranges.select("_range", F.coalesce(F.sum("_gain").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_height"))
    ev = (ev.join(before, "_range")
          .withColumn("_level", F.col("_height") + F.sum("_d").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    ends = ev.where("_kind = 1").groupBy("_range", "_level").agg(F.max_by("rule", "_k").alias("_last"), F.max("_k").alias("_lk"))
    # the stack each range starts with: the last start on each of its levels before it
    stack = (ends.withColumn("_open", F.lit(0)).drop("_lk").unionByName(before.select(
        "_range", F.explode(F.when(F.col("_height") > 0, F.sequence(F.lit(1), F.col("_height")))).alias("_level"), F.lit(1).alias("_open")), True))
    earlier = Window.partitionBy("_level").orderBy("_range", F.desc("_open")).rowsBetween(Window.unboundedPreceding, 0)
    carried = stack.withColumn("_above", F.last("_last", ignorenulls=True).over(earlier)).where("_open = 1").select(
        "_range", F.col("_level").cast("int").alias("_ask"), "_above")
    # a point asks each level of its stack, or the top alone
    asked = F.explode(F.sequence(F.lit(1), F.col("_level").cast("int"))) if levels else F.col("_level").cast("int")
    asks = ev.where("_kind = 2 and _level > 0").withColumn("_ask", asked).unionByName(
        ev.where("_kind = 1").withColumn("_ask", F.col("_level").cast("int")))
    upto = Window.partitionBy("_range", "_ask").orderBy("_k", "_kind", "_t").rowsBetween(Window.unboundedPreceding, 0)
    within = asks.withColumn("_here", F.last("rule", ignorenulls=True).over(upto)).where("_kind = 2")
    out = within.join(carried, ["_range", "_ask"], "left")
    return out.select(*[F.col("_p")[c].alias(c) for c in cols], F.coalesce("_here", "_above").alias("rule"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", range_rows: int = RANGE_ROWS) -> DataFrame:
    """(page, host, path, rule, verdict): every row of ``pages`` as a struct, and the longest rule that fits its URL.

    ``rules`` has strings host, path and verdict. A rule fits its host and all subdomains, if the URL's path starts with the
    rule's; the longest (host and path together, then host) wins; without one ``rule`` is NULL and the verdict ``default``. Of rules alike in host and
    path the verdict that sorts last holds (``block`` before ``allow``). Rules with a NULL host, path or verdict, or with ``/``, ``?`` or ``#`` in the host fit
    nothing. A URL that is NULL or has no ``://`` has an empty host and path. Repeated rows and NULL ids give a row each; an empty
    table of pages gives no rows, an empty one of rules the default for all; the pages' columns stay apart
    in ``page``, so their names clash with nothing.
    """
    rules = (rules.select(F.translate("host", _A, _Z).alias("host"), "path", "verdict")
             .where("host is not null and path is not null and verdict is not null and not host rlike '[/?#]'")
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    parsed = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("page"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    urls = Stash(pages.select(url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")).distinct())
    under = Stash(sweep(urls.df.select("host", "path", host_key(F.col("host")).alias("key")),
                        rules.select("host").distinct().select(host_key(F.col("host")).alias("prefix"), F.col("host").alias("rule")), range_rows))
    below = F.concat(host_key(F.col("rule")), F.lit("/"), F.col("path"))
    fits = sweep(under.df.select("host", "path", below.alias("key")),
                 rules.select(F.concat(host_key(F.col("host")), F.lit("/"), F.col("path")).alias("prefix"), F.struct(
                     (F.length("host") + F.length("path")).alias("n"), F.length("host").alias("n_host"),
                     F.concat("host", "path").alias("rule"), "verdict").alias("rule")), range_rows, levels=False)
    best = stash(fits.groupBy("host", "path").agg(F.max("rule").alias("best")))
    return parsed.join(best, ["host", "path"], "left").select(
        "page", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
