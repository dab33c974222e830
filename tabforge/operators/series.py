"""Ordered-row operators (W1-W9, T1, T4, X5) that never put a series into one task.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends every row of a key to one
task, and a keyless ``Window.orderBy(ts)`` sends the whole table there. Here:

* ``sequence_index`` numbers rows 0..n-1 per key in (order) order: keys longer than
  ``GROUP_ROWS`` -- and a keyless table -- are cut into sub-ranges of the first order column
  at approximate quantiles computed once and inlined as literals; rows are numbered with
  ``row_number`` inside each bounded (key, sub-range) group and shifted by per-group
  offsets. The numbering does not depend on partition indices or sampled bounds, so a
  recomputed task reproduces it without a checkpoint of the data.
* bounded look-back features (lag, rolling, diff) run on blocks of ``block_rows``
  consecutive rows plus a halo of the previous block's last rows, partitioned by
  (key, block): work spreads evenly however skewed the keys are.
* unbounded look-back (forward / backward fill) uses the same blocks plus a
  per-block carry table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tabforge.functions import dates as D
from tabforge.session import cut_lineage, ship_package
from tabforge.functions.scalars import attach

BROADCAST_ROWS = 2_000_000      # offsets / carry tables up to this size are broadcast


def _maybe_broadcast(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast only after checking the row count of the (already materialised) small side."""
    return F.broadcast(small) if small.count() <= limit else small


GROUP_ROWS = 1 << 20            # target rows per numbering group (one window partition)


def _order_number(df: DataFrame, col: str):
    dt = df.schema[col].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(col).cast("timestamp")).cast("double")
    if isinstance(dt, T.DateType):
        return F.unix_date(F.col(col)).cast("double")
    return F.col(col).cast("double")


def sequence_index(df: DataFrame, order_cols: Sequence[str], key_cols: Sequence[str] = (),
                   idx_col: str = "_seq", group_rows: int | None = None, partitions: int | None = None) -> DataFrame:
    """Add a dense 0-based row number per key in ``order_cols`` order (ties: give a unique
    last order column).

    Keys with more than ``group_rows`` rows (and a keyless table) are cut into sub-ranges of
    their first order column at approximate quantiles computed once and inlined as literals;
    rows are numbered inside each (key, sub-range) group with ``row_number`` -- every group
    holds about ``group_rows`` rows -- and a per-group offset (cumulative counts over the small
    group table) makes the numbers global per key. Nothing depends on partition indices or
    sampled bounds, so a recomputed task gets the same numbers and no checkpoint is needed.
    """
    spark = df.sparkSession
    group_rows = group_rows or GROUP_ROWS
    keys, order = list(key_cols), list(order_cols)
    o1 = _order_number(df, order[0])
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.where(F.col("_n") > group_rows).collect()       # at most n / group_rows rows
    data = df
    if hot:
        m = max(math.ceil(r["_n"] / group_rows) for r in hot)
        probs = [i / m for i in range(1, m)]
        if keys:
            hot_df = spark.createDataFrame([tuple(r[k] for k in keys) for r in hot],
                                           ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys))
            src = df.join(F.broadcast(hot_df), keys)
        else:
            src = df
        rows = src.groupBy(*keys).agg(F.percentile_approx(o1, probs, 10_000).alias("_b")).collect()
        bschema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + ["_b array<double>"])
        brow = [tuple([*(r[k] for k in keys), sorted(set(r["_b"] or []))]) for r in rows]
        bdf = spark.createDataFrame(brow, bschema)               # one row per hot key
        if keys:
            sub = F.size(F.filter(F.col("_b"), lambda b: b <= o1))
            data = df.join(F.broadcast(bdf), keys, "left").withColumn("_sub", F.coalesce(sub, F.lit(0))).drop("_b")
        else:                                                    # one series: inline its boundaries
            bounds = F.array(*[F.lit(float(b)) for b in brow[0][0]]) if brow[0][0] else F.array().cast("array<double>")
            data = df.withColumn("_sub", F.size(F.filter(bounds, lambda b: b <= o1)))
    else:
        data = df.withColumn("_sub", F.lit(0))
    sizes = data.groupBy(*keys, "_sub").agg(F.count(F.lit(1)).alias("_gn"))
    if keys:
        before = Window.partitionBy(*keys).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select(*keys, "_sub", F.coalesce(F.sum("_gn").over(before), F.lit(0)).cast("long").alias("_off"))
    else:                                                        # one series: at most n / group_rows groups
        acc, rows = 0, []
        for r in sorted(sizes.collect(), key=lambda r: r["_sub"]):
            rows.append((r["_sub"], acc))
            acc += r["_gn"]
        offsets = spark.createDataFrame(rows, "_sub int, _off long")
    w = Window.partitionBy(*keys, "_sub").orderBy(*order)
    numbered = data.withColumn("_rn", F.row_number().over(w) - 1)
    # the numbered rows are already hash-partitioned by (key, sub-range): the join reuses that
    # partitioning, and AQE broadcasts the offsets table when its measured size is small
    out = numbered.join(offsets, [*keys, "_sub"])
    return out.withColumn(idx_col, (F.col("_off") + F.col("_rn")).cast("long")).drop("_sub", "_rn", "_off")


def with_blocks(indexed: DataFrame, idx_col: str, halo: int, block_rows: int) -> DataFrame:
    """Tag rows with block = idx // block_rows; the last ``halo`` rows of each block are also
    emitted into the next block as halo rows (``_halo`` = true). One generator pass: the
    indexed input is not evaluated twice."""
    if halo >= block_rows:
        raise ValueError("block_rows must exceed the look-back")
    blk = F.floor(F.col(idx_col) / block_rows).cast("long")
    if halo <= 0:
        return indexed.withColumn("_blk", blk).withColumn("_halo", F.lit(False))
    own = F.struct(blk.alias("_blk"), F.lit(False).alias("_halo"))
    nxt = F.struct((blk + 1).alias("_blk"), F.lit(True).alias("_halo"))
    tags = F.when(F.col(idx_col) % block_rows >= block_rows - halo, F.array(own, nxt)).otherwise(F.array(own))
    return indexed.withColumn("_tag", F.explode(tags)).select("*", "_tag._blk", "_tag._halo").drop("_tag")


# Rolling aggregate by name (D3 / W3): pandas method name -> (Spark window aggregate, ddof note)
def _rolling_agg(func: str, col):
    if func == "mean":
        return F.avg(col)
    if func == "std":
        return F.stddev_samp(col)
    if func == "var":
        return F.var_samp(col)
    if func == "min":
        return F.min(col)
    if func == "max":
        return F.max(col)
    if func == "sum":
        return F.sum(col)
    if func == "median":
        return None  # handled in series_features from the sorted frame values
    if func == "count":
        return F.count(col).cast("double")
    if func in ("skew", "kurt"):
        return None  # handled in series_features from population moments
    raise ValueError(f"unknown rolling function {func!r}")


ROLLING_FUNCS = ("mean", "std", "var", "min", "max", "sum", "median", "count", "skew", "kurt")


WIDE = 32                        # look-back features beyond which numpy computes them
FRAME_FUNCS = ("mean", "std", "var", "min", "max", "sum")


def frames(past, there, name: str, shifted: bool, lags, windows, funcs, diffs):
    """(column, values, which of them are present) for the look-back features of one column. ``past(k)`` and ``there(k)`` are
    its values ``k`` rows earlier and which of these are present. Sums and moments run in row order, as Spark's frames do."""
    import numpy as np
    for k in lags:
        yield f"{name}_lag_{k}", past(k), there(k)
    end = 1 if shifted else 0
    for win in windows:
        first = win - 1 + end
        total = mean = least = most = past(first)
        square, ok = np.zeros(len(total)), there(first)
        for n, k in enumerate(range(first - 1, end - 1, -1), 2):
            x, ok = past(k), ok & there(k)
            total, least, most = total + x, np.minimum(least, x), np.maximum(most, x)
            delta = x - mean
            part = delta / n
            mean, square = mean + part, square + delta * (delta - part)
        var = square / max(win - 1, 1)
        out = {"mean": total / win, "std": np.sqrt(var), "var": var, "min": least, "max": most, "sum": total}
        for f in funcs:
            yield f"{name}_rolling_{win}_{f}", out[f], ok & (win > 1) if f in ("std", "var") else ok
    for k in diffs:
        yield f"{name}_diff_{k}", past(end) - past(k + end), there(end) & there(k + end)


def _frame_batches(batches, cols, shift_cols, lags, windows, funcs, diffs, halo: int, names):
    """Look-back features of sorted rows, batch by batch; ``_at`` numbers the rows of a block from 1, and the last ``halo`` rows of
    a batch are kept for the next."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute
    kept = [np.zeros(halo) for _ in cols]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        at, own = batch.column("_at").to_numpy(), pa.compute.invert(batch.column("_halo"))
        made = {}
        for i, c in enumerate(cols):
            v = np.concatenate([kept[i], batch.column(f"_v{i}").to_numpy(zero_copy_only=False)])
            kept[i], present = v[len(v) - halo:], ~np.isnan(v)
            with np.errstate(all="ignore"):
                for name, values, ok in frames(lambda k: v[halo - k:halo - k + n], lambda k: present[halo - k:halo - k + n] & (at > k),
                                               c, c in shift_cols, lags, windows, funcs, diffs):
                    made[name] = pa.array(values, mask=~ok)
        arrays = [made[c] if c in made else batch.column(c) for c in names]
        yield pa.RecordBatch.from_arrays(arrays, names=names).filter(own)


def _numpy_features(blocks: DataFrame, window, value_cols, shift_cols, lags, windows, funcs, diffs, halo: int) -> DataFrame:
    """``series_features`` of many columns: hundreds of window frames take the optimizer and the window operator far longer than the
    sums take numpy. Spark sorts and numbers the rows of each block, which a task then passes through in batches."""
    ship_package(blocks.sparkSession)
    rows = blocks.select("*", F.row_number().over(window).alias("_at"),
                         *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(value_cols)])
    old = [f for f in blocks.schema.fields if f.name not in ("_blk", "_halo")]
    new = [name for c in value_cols for name in
           [f"{c}_lag_{k}" for k in lags] + [f"{c}_rolling_{w}_{f}" for w in windows for f in funcs] + [f"{c}_diff_{k}" for k in diffs]]
    names, cols, shifted = [f.name for f in old] + new, list(value_cols), list(shift_cols)
    given = tuple(map(tuple, (lags, windows, funcs, diffs)))
    return rows.mapInArrow(lambda it: _frame_batches(it, cols, shifted, *given, halo, names),
                           T.StructType(old + [T.StructField(c, T.DoubleType()) for c in new]))


def series_features(df: DataFrame, value_cols: Sequence[str], order_cols: Sequence[str],
                    key_cols: Sequence[str] = (), lags: Sequence[int] = (1, 7, 14, 30),
                    windows: Sequence[int] = (7, 14, 30), funcs: Sequence[str] = ("mean", "std", "min", "max"),
                    diffs: Sequence[int] = (1, 7), block_rows: int = 1 << 20,
                    shift_cols: Sequence[str] = (), indexed: DataFrame | None = None,
                    idx_col: str = "_seq", keep_index: bool = False) -> DataFrame:
    """Lag (``{c}_lag_{k}``), rolling (``{c}_rolling_{w}_{f}``, NULL until w non-null values,
    current row included) and difference (``{c}_diff_{k}``) features per key.

    ``shift_cols`` lists columns whose rolling frames end one row earlier and that get no
    ``diff`` at lag 0 -- the leakage-safe form used for a forecasting target.
    """
    bad = [f for f in funcs if f not in ROLLING_FUNCS]
    if bad:
        raise ValueError(f"unknown rolling functions {bad}")
    keys = list(key_cols)
    halo = max([0, *lags, *[w for w in windows], *diffs]) + (1 if shift_cols else 0)
    ix = indexed if indexed is not None else sequence_index(df, order_cols, keys, idx_col)
    blocks = with_blocks(ix, idx_col, halo, block_rows)
    w = Window.partitionBy(*keys, "_blk").orderBy(idx_col)
    if len(value_cols) * (len(lags) + len(windows) * len(funcs) + len(diffs)) > WIDE and set(funcs) <= set(FRAME_FUNCS):
        out = _numpy_features(blocks, w, value_cols, shift_cols, lags, windows, funcs, diffs, halo)
        return out if keep_index else out.drop(idx_col)
    new = []
    for c in value_cols:
        x = F.col(c).cast("double")
        x = F.when(~F.isnan(x), x)
        end = -1 if c in shift_cols else 0
        for k in lags:
            new.append(F.lag(x, k).over(w).alias(f"{c}_lag_{k}"))
        for win in windows:
            frame = w.rowsBetween(-(win - 1) + end, end)
            full = F.count(x).over(frame) == win
            for f in funcs:
                if f == "median":
                    arr = F.array_sort(F.collect_list(x).over(frame))
                    m = F.size(arr)
                    lo = F.element_at(arr, F.floor((m + 1) / 2).cast("int"))
                    hi = F.element_at(arr, F.floor(m / 2).cast("int") + 1)
                    v = (lo + hi) / 2
                elif f in ("skew", "kurt"):
                    n = F.lit(float(win))
                    if f == "skew":
                        g = F.skewness(x).over(frame)
                        v = g * F.sqrt(n * (n - 1)) / (n - 2)
                    else:
                        g = F.kurtosis(x).over(frame)
                        v = ((n + 1) * g + 6) * (n - 1) / ((n - 2) * (n - 3))
                else:
                    v = _rolling_agg(f, x).over(frame)
                new.append(F.when(full, v).alias(f"{c}_rolling_{win}_{f}"))
        for k in diffs:
            if c in shift_cols:
                new.append((F.lag(x, 1).over(w) - F.lag(x, k + 1).over(w)).alias(f"{c}_diff_{k}"))
            else:
                new.append((x - F.lag(x, k).over(w)).alias(f"{c}_diff_{k}"))
    out = blocks.select("*", *new).where(~F.col("_halo")).drop("_blk", "_halo")
    return out if keep_index else out.drop(idx_col)


def fill_series(df: DataFrame, cols: Sequence[str], order_cols: Sequence[str], key_cols: Sequence[str] = (),
                block_rows: int = 1 << 20, idx_col: str = "_seq") -> DataFrame:
    """Forward fill, then backward fill, then the column mean (W5), per key in order.

    Within a block, ``last/first(ignorenulls)`` windows fill locally; the block summaries
    (last / first non-null value of each block) are read off the same windowed rows, carried
    across blocks with a window over the small per-block table, and joined back (AQE turns
    that join into a broadcast when the block table is small). One plan, so the numbered
    rows are shuffled once.
    """
    keys = list(key_cols)
    ix = sequence_index(df, order_cols, keys, idx_col)
    b = ix.withColumn("_blk", F.floor(F.col(idx_col) / block_rows).cast("long"))
    # both directions as growing frames, which are linear; a frame that shrinks from the front is
    # evaluated anew for every row. NaN is missing, like NULL.
    grow = (Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys, "_blk").orderBy(idx_col).rowsBetween(*grow)
    after = Window.partitionBy(*keys, "_blk").orderBy(F.col(idx_col).desc()).rowsBetween(*grow)
    floating = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("float", "double")}

    def present(c):
        return F.when(~F.isnan(F.col(c)), F.col(c)) if c in floating else F.col(c)
    loc = b.select("*", *[F.last(present(c), True).over(before).alias(f"_ff_{c}") for c in cols],
                   *[F.last(present(c), True).over(after).alias(f"_bf_{c}") for c in cols])
    # block summaries from the windowed rows: the forward fill at the block's last row is the
    # block's last non-null value, the backward fill at its first row the first non-null one
    summ = loc.groupBy(*keys, "_blk").agg(
        *[F.max_by(F.col(f"_ff_{c}"), F.col(idx_col)).alias(f"_l_{c}") for c in cols],
        *[F.min_by(F.col(f"_bf_{c}"), F.col(idx_col)).alias(f"_f_{c}") for c in cols])
    ws = Window.partitionBy(*keys).orderBy("_blk")
    carry = summ.select(*keys, "_blk",
                        *[F.last(f"_l_{c}", True).over(ws.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_cl_{c}")
                          for c in cols],
                        *[F.first(f"_f_{c}", True).over(ws.rowsBetween(1, Window.unboundedFollowing)).alias(f"_cf_{c}")
                          for c in cols])
    means = df.agg(*[F.avg(present(c)).alias(f"_m_{c}") for c in cols])
    j = attach(loc.join(carry, [*keys, "_blk"]), means)
    filled = {c: F.coalesce(F.col(f"_ff_{c}"), F.col(f"_cl_{c}"), F.col(f"_bf_{c}"), F.col(f"_cf_{c}"),
                            F.col(f"_m_{c}")) for c in cols}
    sel = [filled[c].alias(c) if c in filled else F.col(c) for c in df.columns]
    return j.select(*sel)


# ---------------------------------------------------------------- adjacent-pair statistics

def _adjacent_partials(it):
    """One summary row per partition (sorted by the order column, so batches arrive as
    consecutive slices; steps across batch borders are included)."""
    import numpy as np
    import pandas as pd
    n, o_first, first, last = 0, None, None, None
    up = down = 0
    dmin = dmax = None
    s1 = s2 = 0.0
    for pdf in it:
        if len(pdf) == 0:
            continue
        v = pdf["v"].to_numpy(dtype="float64")
        d = np.diff(v)
        if last is not None:
            d = np.concatenate([[v[0] - last], d])
        if len(d):
            up += int((d > 0).sum())
            down += int((d < 0).sum())
            dmin = float(d.min()) if dmin is None else min(dmin, float(d.min()))
            dmax = float(d.max()) if dmax is None else max(dmax, float(d.max()))
            s1 += float(d.sum())
            s2 += float((d * d).sum())
        if o_first is None:
            o_first, first = float(pdf["o"].iloc[0]), float(v[0])
        last = float(v[-1])
        n += len(v)
    if n:
        yield pd.DataFrame({"o_first": [o_first], "n": [n], "first": [first], "last": [last], "n_up": [up],
                            "n_down": [down], "dmin": [dmin], "dmax": [dmax], "s1": [s1], "s2": [s2]})


def adjacent_stats(df: DataFrame, order_col: str, value_col: str, partitions: int | None = None) -> dict:
    """Statistics of consecutive differences of ``value_col`` in ``order_col`` order:
    counts of increases / decreases, min / max / mean / population std of the steps.

    Range partitions are summarised in numpy (one row each); steps across partition
    borders are added on the driver from those rows. The answer does not depend on
    the sampled bounds, so no checkpoint is needed.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ship_package(spark)
    base = df.select(F.col(order_col).cast("double").alias("o"), F.col(value_col).cast("double").alias("v"))
    rows = (base.repartitionByRange(parts, "o").sortWithinPartitions("o")
            .mapInPandas(_adjacent_partials, "o_first double, n long, first double, last double, n_up long, "
                                             "n_down long, dmin double, dmax double, s1 double, s2 double")
            .collect())
    rows = sorted(rows, key=lambda r: r["o_first"])
    n = sum(r["n"] for r in rows)
    up = sum(r["n_up"] for r in rows)
    down = sum(r["n_down"] for r in rows)
    s1 = sum(r["s1"] for r in rows)
    s2 = sum(r["s2"] for r in rows)
    dm = [r["dmin"] for r in rows if r["dmin"] is not None]
    dx = [r["dmax"] for r in rows if r["dmax"] is not None]
    for a, b in zip(rows, rows[1:]):
        d = b["first"] - a["last"]
        up += d > 0
        down += d < 0
        s1 += d
        s2 += d * d
        dm.append(d)
        dx.append(d)
    steps = max(n - 1, 0)
    mean = s1 / steps if steps else None
    std = math.sqrt(max(s2 / steps - mean * mean, 0.0)) if steps else None
    return {"n": n, "n_up": int(up), "n_down": int(down), "step_min": min(dm) if dm else None,
            "step_max": max(dx) if dx else None, "step_mean": mean, "step_std": std}


def monotonic_check(df: DataFrame, ts_col: str, seq_col: str) -> dict:
    """Is ``ts_col`` non-strictly increasing or decreasing in ``seq_col`` order (W6)?"""
    s = adjacent_stats(df.withColumn("__t", F.unix_micros(F.col(ts_col).cast("timestamp"))), seq_col, "__t")
    return {"increasing": s["n_down"] == 0, "decreasing": s["n_up"] == 0,
            "monotonic": s["n_down"] == 0 or s["n_up"] == 0, **s}


def duplicate_count(df: DataFrame, col: str) -> DataFrame:
    """Rows minus distinct values."""
    return df.agg((F.count(F.lit(1)) - F.count_distinct(F.col(col))).alias("n_duplicates"))


def infer_frequency(df: DataFrame, ts_col: str) -> str | None:
    """Frequency code of the distinct timestamps when every step is equal (W8); None otherwise.

    Fixed-length steps map to the longest of S/T/H/D/W that divides them, with a multiplier (``15T``); calendar steps on
    month starts to MS/QS/AS and on month ends to M/Q/A, likewise; weekday-only dates with 1- or 3-day steps to B.
    """
    # wall-clock time (timestamp without time zone): steps do not change with the session
    # time zone or daylight-saving shifts
    t = F.col(ts_col).cast("timestamp_ntz")
    wall = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', t)")
    dist = df.select(t.alias("t")).where(F.col("t").isNotNull()).distinct().withColumn("s", wall)
    flags = dist.agg(F.count(F.lit(1)).alias("n"),
                     F.min(F.dayofmonth("t")).alias("dmin"), F.max(F.dayofmonth("t")).alias("dmax"),
                     F.min(F.when(F.to_date("t") == F.last_day("t"), 1).otherwise(0)).alias("all_me"),
                     F.max(F.pmod(F.col("s"), F.lit(86_400))).alias("tod"),
                     F.max(F.when(F.weekday("t") >= 5, 1).otherwise(0)).alias("weekend")).first()
    if flags["n"] < 3:
        return None
    secs = dist.select(F.col("s").alias("o"))
    s = adjacent_stats(secs.withColumn("v", F.col("o")), "o", "v")
    units = ((7 * 86400, "W"), (86400, "D"), (3600, "H"), (60, "T"), (1, "S"))
    fixed = _multiple(s["step_min"], units) if s["step_min"] == s["step_max"] else None
    months = dist.select(F.col("s").alias("o"), (F.year("t") * 12 + F.month("t")).alias("v"))
    m = adjacent_stats(months, "o", "v")
    if m["step_min"] == m["step_max"] and flags["tod"] == 0:
        step = int(m["step_min"])
        if flags["dmin"] == flags["dmax"] == 1:
            return _multiple(step, ((12, "AS"), (3, "QS"), (1, "MS")))
        if flags["all_me"] == 1:
            return _multiple(step, ((12, "A"), (3, "Q"), (1, "M")))
    if fixed:
        return fixed
    if (flags["weekend"] == 0 and flags["tod"] == 0 and s["step_min"] == 86400
            and s["step_max"] == 3 * 86400):
        return "B"
    return None


def _multiple(step, units) -> str | None:
    """The code of a step by the longest unit that divides it, with the multiplier in front."""
    for size, code in units:
        n, left = divmod(int(step), size)
        if n and not left and step == int(step):
            return code if n == 1 else f"{n}{code}"
    return None


def seasonal_period(freq: str | None) -> int:
    return D.SEASONAL_PERIOD.get(freq or "D", 1)


def frequency_table(df: DataFrame, ts_col: str) -> DataFrame:
    """One row: inferred code (NULL if irregular), code used (default D) and seasonal period."""
    f = infer_frequency(df, ts_col)
    used = f or "D"
    base = df.agg(F.count_distinct(F.col(ts_col)).alias("n_distinct"))
    return base.select("n_distinct", F.lit(f).cast("string").alias("inferred_freq"),
                       F.lit(used).alias("freq"), F.lit(seasonal_period(used)).alias("seasonal_period"))


def future_dates(df: DataFrame, ts_col: str, key_cols: Sequence[str] = (), freq: str = "D",
                 horizon: int = 7) -> DataFrame:
    """Next ``horizon`` timestamps after each series' last one."""
    last = df.groupBy(*key_cols).agg(F.max(F.col(ts_col)).alias("__last"))
    return last.select(*key_cols, F.posexplode(D.future_dates(F.col("__last"), freq, horizon)).alias("step", ts_col)) \
               .withColumn("step", F.col("step") + 1)


def tail_rows(df: DataFrame, n: int, order_cols: Sequence[str], key_cols: Sequence[str] = ()) -> DataFrame:
    """Last ``n`` rows per key in order (T4), via the sequence index and per-key counts."""
    keys = list(key_cols)
    ix = sequence_index(df, order_cols, keys, "_seq")
    cnt = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
    cnt = cnt if not keys else _maybe_broadcast(cut_lineage(cnt))
    j = ix.join(cnt, keys) if keys else attach(ix, cnt)
    return j.where(F.col("_seq") >= F.col("_cnt") - n).drop("_cnt", "_seq")


def cumulative_sum(df: DataFrame, col: str, order_cols: Sequence[str], key_cols: Sequence[str] = (),
                   out_col: str | None = None, block_rows: int = 1 << 20) -> DataFrame:
    """Running sum in order per key (W9): a running window per block, plus the carried total
    of the earlier blocks (each block's total is its last running value), in one plan."""
    keys = list(key_cols)
    ix = sequence_index(df, order_cols, keys, "_seq")
    b = ix.withColumn("_blk", F.floor(F.col("_seq") / block_rows).cast("long"))
    w = Window.partitionBy(*keys, "_blk").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    loc = b.withColumn("_cs", F.sum(F.col(col)).over(w))
    tot = loc.groupBy(*keys, "_blk").agg(F.max_by(F.col("_cs"), F.col("_seq")).alias("_bs"))
    ws = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = tot.select(*keys, "_blk", F.coalesce(F.sum("_bs").over(ws), F.lit(0)).alias("_carry"))
    out = loc.join(carry, [*keys, "_blk"])
    return out.withColumn(out_col or f"{col}_cumsum", F.col("_cs") + F.col("_carry")) \
              .drop("_blk", "_cs", "_carry", "_seq")
