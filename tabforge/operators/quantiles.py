"""Exact quantiles without funnelling a column through one task.

Spark's exact ``percentile`` aggregate merges a value->count map of the whole
column in a single final task, which does not survive a 100 TB column. Here the
order statistics that linear interpolation needs are found by histogram
refinement instead:

1. one aggregate gives ``count/min/max`` per column;
2. each round, every unresolved rank keeps a value window ``[lo, hi]`` known to
   hold it; one distributed ``groupBy(window, bucket)`` counts the rows of each
   window in ``bins`` equal-width buckets (map-side partial aggregation, the
   result is at most ``windows x bins`` rows) and the window shrinks to the
   bucket that holds the rank;
3. once a window holds at most ``final_rows`` rows, one ``groupBy(window, value)``
   returns its distinct values with counts and the rank is read off exactly.

Every round is one scan of the projected columns; the driver only sees the
bounded histograms. Results equal pandas ``quantile`` / DuckDB ``quantile_cont``
(linear interpolation between the order statistics at ``floor(h)`` and
``floor(h)+1`` with ``h = (n-1) p``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T


def long_values(df: DataFrame, cols: Sequence[str], name_col: str = "column_name",
                value_col: str = "v") -> DataFrame:
    """Unpivot numeric columns to (column_name, v) dropping NULL and NaN (pandas' missing)."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name_col), F.col(c).cast("double").alias(value_col))
                      for c in cols])
    out = df.select(F.inline(pairs))
    return out.where(F.col(value_col).isNotNull() & ~F.isnan(F.col(value_col)))


def _signed_log(v):
    """Monotone scale on which any spread of doubles, infinities included, has a bounded width."""
    return F.signum(v) * F.least(F.log(F.greatest(F.abs(v), F.lit(5e-324))) + F.lit(750.0), F.lit(1460.0))


def _solve(long: DataFrame, targets: dict, bins: int, final_rows: int) -> dict:
    """targets: key -> (column, rank, lo, hi, below, count); returns key -> value.

    Each round: one distributed histogram per open window, cumulative counts per window
    (a window over at most ``bins`` -- or ``final_rows`` for exact windows -- rows), and a
    join with the ranks, so only one row per rank reaches the driver.
    """
    from pyspark.sql import Window
    spark = long.sparkSession
    result: dict = {}
    active = dict(targets)
    # Every round splits each open window, since its least and greatest value fall into different
    # buckets, so the loop ends. Windows with an infinite end, and every second round from the third on,
    # have buckets on a logarithmic scale: values of any spread take a few rounds.
    done = 0
    while active:
        windows: dict = {}
        for key, (col, rank, lo, hi, below, cnt) in active.items():
            if lo == hi:
                result[key] = lo
                continue
            windows.setdefault((col, lo, hi, cnt <= final_rows), len(windows))
        active = {k: v for k, v in active.items() if k not in result}
        if not windows:
            break
        keys = list(active)
        wide = done >= 2 and done % 2 == 0
        wrows = [(wid, col, float(lo), float(hi), bool(exact), wide or math.isinf(hi - lo) or math.isnan(hi - lo))
                 for (col, lo, hi, exact), wid in windows.items()]
        done += 1
        trows = []
        for tid, key in enumerate(keys):
            col, rank, lo, hi, below, cnt = active[key]
            trows.append((tid, windows[(col, lo, hi, cnt <= final_rows)], int(rank - below)))
        # both tables have at most 2 x columns x probabilities rows: broadcasts are bounded
        wdf = spark.createDataFrame(wrows, "wid int, wcol string, lo double, hi double, exact boolean, wide boolean")
        tdf = spark.createDataFrame(trows, "tid int, wid int, r long")
        j = long.join(F.broadcast(wdf), (F.col("column_name") == F.col("wcol"))
                      & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        def place(v, lo, hi):
            return F.least(F.floor(F.try_divide(v - lo, hi - lo) * bins), F.lit(bins - 1)).cast("double")
        log = place(*[_signed_log(F.col(c)) for c in ("v", "lo", "hi")])
        # where two values are one on the logarithmic scale, the linear one tells them apart
        bucket = F.when(F.col("exact"), F.col("v")).when(F.col("wide"), F.coalesce(log, place(*map(F.col, ("v", "lo", "hi"))))).otherwise(
            place(*map(F.col, ("v", "lo", "hi"))))
        hist = j.groupBy("wid", bucket.alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx"))
        before = Window.partitionBy("wid").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        cum = hist.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        hits = cum.join(F.broadcast(tdf), "wid").where(
            (F.col("before") <= F.col("r")) & (F.col("r") < F.col("before") + F.col("n"))) \
            .select("tid", "before", "n", "mn", "mx").collect()
        found = {h["tid"]: h for h in hits}
        nxt = {}
        for tid, key in enumerate(keys):
            col, rank, lo, hi, below, cnt = active[key]
            h = found.get(tid)
            if h is None:  # pragma: no cover - a rank outside its window would be a bug
                raise RuntimeError(f"rank {rank} not found for {col}")
            if h["mn"] == h["mx"] or cnt <= final_rows:
                result[key] = h["mn"]
            else:
                nxt[key] = (col, rank, h["mn"], h["mx"], below + h["before"], h["n"])
        active = nxt
    return result


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], *,
                    bins: int = 4096, final_rows: int = 200_000,
                    stats: dict | None = None) -> dict[tuple[str, float], float | None]:
    """Exact linear-interpolated quantiles for several columns and probabilities.

    Returns ``{(column, p): value}``; ``None`` where a column has no non-missing value.
    ``stats`` may pass precomputed ``{col: (n, min, max)}`` to save the first scan.
    """
    cols = list(cols)
    if not cols:
        return {}
    long = long_values(df, cols)
    if stats is None:
        rows = long.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("mn"),
                                                F.max("v").alias("mx")).collect()
        stats = {r["column_name"]: (r["n"], r["mn"], r["mx"]) for r in rows}
    targets = {}
    plan = {}
    for c in cols:
        n, mn, mx = stats.get(c, (0, None, None))
        for p in probs:
            if not n:
                plan[(c, p)] = None
                continue
            h = (n - 1) * p
            k1 = int(math.floor(h))
            k2 = min(k1 + 1, n - 1)
            plan[(c, p)] = (k1, k2, h - k1)
            for k in (k1, k2):
                targets[(c, k)] = (c, k, mn, mx, 0, n)
    solved = _solve(long, targets, bins, final_rows)
    out = {}
    for key, spec in plan.items():
        if spec is None:
            out[key] = None
            continue
        k1, k2, frac = spec
        lo, hi = solved[(key[0], k1)], solved[(key[0], k2)]
        out[key] = lo + (hi - lo) * frac
    return out


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float], **kw) -> DataFrame:
    """Long DataFrame (column_name, p, value) of exact quantiles."""
    q = exact_quantiles(df, cols, probs, **kw)
    rows = [(c, float(p), None if v is None else float(v)) for (c, p), v in q.items()]
    schema = T.StructType([T.StructField("column_name", T.StringType()),
                           T.StructField("p", T.DoubleType()),
                           T.StructField("value", T.DoubleType())])
    return df.sparkSession.createDataFrame(rows, schema)


def approx_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                     accuracy: int = 100_000) -> dict[tuple[str, float], float | None]:
    """``percentile_approx`` variant for callers that accept a rank error of n/accuracy."""
    aggs = [F.percentile_approx(F.col(c).cast("double"), list(probs), accuracy).alias(c) for c in cols]
    row = df.select([F.when(~F.isnan(F.col(c).cast("double")), F.col(c)).alias(c) for c in cols]).agg(*aggs).first()
    out = {}
    for c in cols:
        vals = row[c]
        for i, p in enumerate(probs):
            out[(c, p)] = None if vals is None else float(vals[i])
    return out


def order_statistics(long: DataFrame, ranks: dict, **kw) -> dict:
    """Exact k-th smallest value (0-based) per group of a long (column_name, v) table.

    ``ranks`` maps any key to ``(group, k)``; groups are the values of ``column_name``
    (a column name, a class label, ...). Returns key -> value.
    """
    if not ranks:
        return {}
    rows = long.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("mn"),
                                            F.max("v").alias("mx")).collect()
    stats = {r["column_name"]: (r["n"], r["mn"], r["mx"]) for r in rows}
    targets = {}
    for key, (g, k) in ranks.items():
        n, mn, mx = stats[g]
        if not 0 <= k < n:
            raise ValueError(f"rank {k} outside 0..{n - 1} for {g}")
        targets[(g, k)] = (g, k, mn, mx, 0, n)
    solved = _solve(long, targets, kw.get("bins", 4096), kw.get("final_rows", 200_000))
    return {key: solved[(g, k)] for key, (g, k) in ranks.items()}
