"""Cleaning, encoding, scaling and splitting (F1-F16).

Every fit is an aggregate that returns a small parameter dict (one entry per
column); every transform is a projection built from those literals, so it stays
inside whole-stage codegen. ``to_sql_transformer`` turns a fitted projection
into a persistable ``SQLTransformer`` stage for a ``PipelineModel``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Column, Window, functions as F, types as T

from tabforge.functions.hashing import hash_unit, hash_fraction_expr
from tabforge.operators.profile import column_types
from tabforge.operators.quantiles import exact_quantiles, order_statistics
from tabforge.functions.scalars import attach


def _num(c: str) -> Column:
    col = F.col(c).cast("double")
    return F.when(~F.isnan(col), col)          # NaN -> NULL (pandas treats both as missing)


def _lit_sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, float):
        if math.isnan(v):
            return "double('NaN')"
        return repr(float(v)) + "D"
    return str(v)


# ---------------------------------------------------------------- F1 / F2 imputation

def modes(df: DataFrame, cols: Sequence[str]) -> dict:
    """Most frequent non-null value per column (ties: smallest), type preserved per column."""
    out = {}
    if not cols:
        return out
    types = {c: df.schema[c].dataType for c in cols}
    numeric = [c for c in cols if not isinstance(types[c], T.StringType)]
    strings = [c for c in cols if isinstance(types[c], T.StringType)]
    for group, cast in ((numeric, "double"), (strings, "string")):
        if not group:
            continue
        pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast(cast).alias("v")) for c in group])
        long = df.select(F.inline(pairs)).where(F.col("v").isNotNull())
        if cast == "double":
            long = long.where(~F.isnan("v"))
        counts = long.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
        key = F.struct((-F.col("n")).alias("neg_n"), F.col("v").alias("v"))
        for r in counts.groupBy("column_name").agg(F.min(key).alias("best")).collect():
            out[r["column_name"]] = r["best"]["v"]
    return out


def fit_imputer(df: DataFrame, cols: Sequence[str], strategy: str = "mean", fill_value=None) -> dict:
    """Fill value per column. mean / median / most_frequent / constant (sklearn semantics)."""
    cols = list(cols)
    if not cols:
        return {}
    if strategy == "mean":
        row = df.agg(*[F.avg(_num(c)).alias(c) for c in cols]).first()
        return {c: row[c] for c in cols}
    if strategy == "median":
        q = exact_quantiles(df, cols, (0.5,))
        return {c: q[(c, 0.5)] for c in cols}
    if strategy == "most_frequent":
        return modes(df, cols)
    if strategy == "constant":
        out = {}
        for c in cols:
            if fill_value is not None:
                out[c] = fill_value
            elif isinstance(df.schema[c].dataType, T.StringType):
                out[c] = "missing_value"
            else:
                out[c] = 0.0
        return out
    raise ValueError(f"unknown imputation strategy {strategy!r}")


def impute_exprs(df: DataFrame, fills: dict) -> dict[str, str]:
    """SQL expression per column that fills NULL (and NaN for floats)."""
    out = {}
    for c, v in fills.items():
        q = f"`{c}`"
        if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            out[c] = f"CASE WHEN {q} IS NULL OR isnan({q}) THEN {_lit_sql(v)} ELSE {q} END"
        elif v is None:
            out[c] = q
        elif isinstance(v, str):
            out[c] = f"coalesce({q}, {_lit_sql(v)})"
        elif isinstance(v, float) and not float(v).is_integer():
            out[c] = f"coalesce(CAST({q} AS DOUBLE), {_lit_sql(float(v))})"     # a mean of integers is fractional
        else:
            cast = df.schema[c].dataType.simpleString()
            out[c] = f"coalesce({q}, CAST({_lit_sql(v)} AS {cast}))"
    return out


def apply_exprs(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """Replace (or add) columns by SQL expressions in one projection."""
    sel = []
    for c in df.columns:
        sel.append(F.expr(exprs[c]).alias(c) if c in exprs else F.col(f"`{c}`"))
    for c, e in exprs.items():
        if c not in df.columns:
            sel.append(F.expr(e).alias(c))
    return df.select(*sel)


def impute(df: DataFrame, cols: Sequence[str], strategy: str = "mean", fill_value=None,
           fit_on: DataFrame | None = None) -> DataFrame:
    fills = fit_imputer(fit_on if fit_on is not None else df, cols, strategy, fill_value)
    return apply_exprs(df, impute_exprs(df, fills))


# ---------------------------------------------------------------- F3 / F4 / F5 outliers

def outlier_bounds(df: DataFrame, cols: Sequence[str], method: str = "iqr", threshold: float = 1.5) -> dict:
    """(lower, upper) per column: IQR (q1 - t iqr, q3 + t iqr) or z-score (mean -+ t std, ddof 1)."""
    cols = list(cols)
    if not cols:
        return {}
    if method == "iqr":
        q = exact_quantiles(df, cols, (0.25, 0.75))
        out = {}
        for c in cols:
            q1, q3 = q[(c, 0.25)], q[(c, 0.75)]
            out[c] = (None, None) if q1 is None else (q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1))
        return out
    if method == "zscore":
        row = df.agg(*[F.avg(_num(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.stddev_samp(_num(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        out = {}
        for i, c in enumerate(cols):
            m, s = row[f"m{i}"], row[f"s{i}"]
            out[c] = (None, None) if m is None or s is None else (m - threshold * s, m + threshold * s)
        return out
    raise ValueError(f"unknown outlier method {method!r}")


def clip_exprs(bounds: dict) -> dict[str, str]:
    """Clip that leaves NULL and NaN as they are (``least(greatest(NULL, a), b)`` would not be NULL)."""
    out = {}
    for c, (lo, hi) in bounds.items():
        if lo is None:
            continue
        q = f"`{c}`"
        out[c] = (f"CASE WHEN {q} IS NULL THEN NULL WHEN isnan(CAST({q} AS DOUBLE)) THEN CAST({q} AS DOUBLE) WHEN {q} < {_lit_sql(lo)} THEN {_lit_sql(lo)} "
                  f"WHEN {q} > {_lit_sql(hi)} THEN {_lit_sql(hi)} ELSE CAST({q} AS DOUBLE) END")
    return out


def outlier_counts(df: DataFrame, bounds: dict, strategy: str = "clip") -> DataFrame:
    """Rows affected per column. For ``remove`` the count of column j only counts rows
    still present after columns 1..j-1 removed theirs (the reference's ordered pass)."""
    items = [(c, lo, hi) for c, (lo, hi) in bounds.items() if lo is not None]
    aggs = []
    kept = F.lit(True)
    for i, (c, lo, hi) in enumerate(items):
        v = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        outside = (v < lo) | (v > hi)
        cond = outside & kept if strategy == "remove" else outside
        aggs.append(F.sum(F.when(cond, 1).otherwise(0)).cast("long").alias(f"n{i}"))
        kept = kept & F.coalesce(~outside, F.lit(True))
    if not items:
        return df.sparkSession.createDataFrame([], "column_name string, lower double, upper double, n_outliers long")
    row = df.agg(*aggs)
    stack = ", ".join(f"'{c}', {_lit_sql(float(lo))}, {_lit_sql(float(hi))}, n{i}" for i, (c, lo, hi) in enumerate(items))
    return row.selectExpr(f"stack({len(items)}, {stack}) AS (column_name, lower, upper, n_outliers)")


def apply_outliers(df: DataFrame, bounds: dict, strategy: str = "clip") -> DataFrame:
    """clip: CASE-clip each column; remove: drop rows outside any bound (inclusive bounds keep);
    none: unchanged. NULLs are never removed or changed."""
    if strategy == "none":
        return df
    if strategy == "clip":
        return apply_exprs(df, clip_exprs(bounds))
    if strategy == "remove":
        cond = F.lit(True)
        for c, (lo, hi) in bounds.items():
            if lo is None:
                continue
            v = F.col(c).cast("double")
            cond = cond & (v.isNull() | F.isnan(v) | ((v >= lo) & (v <= hi)))
        return df.where(cond)
    raise ValueError(f"unknown outlier strategy {strategy!r}")


# ---------------------------------------------------------------- F6 / F7 / F8 scaling

def fit_scaler(df: DataFrame, cols: Sequence[str], method: str = "standard") -> dict:
    """(center, scale) per column, sklearn semantics: standard uses the population std,
    a zero scale becomes 1; minmax maps [min, max] to [0, 1]; robust uses median and IQR."""
    cols = list(cols)
    if not cols or method == "none":
        return {}
    if method == "standard":
        row = df.agg(*[F.avg(_num(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.stddev_pop(_num(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        return {c: (row[f"m{i}"], (row[f"s{i}"] or 1.0) if row[f"s{i}"] not in (0, 0.0) else 1.0)
                for i, c in enumerate(cols)}
    if method == "minmax":
        row = df.agg(*[F.min(_num(c)).alias(f"a{i}") for i, c in enumerate(cols)],
                     *[F.max(_num(c)).alias(f"b{i}") for i, c in enumerate(cols)]).first()
        out = {}
        for i, c in enumerate(cols):
            lo, hi = row[f"a{i}"], row[f"b{i}"]
            rng = None if lo is None else hi - lo
            out[c] = (lo, rng if rng else 1.0)
        return out
    if method == "robust":
        q = exact_quantiles(df, cols, (0.25, 0.5, 0.75))
        out = {}
        for c in cols:
            med = q[(c, 0.5)]
            iqr = None if med is None else q[(c, 0.75)] - q[(c, 0.25)]
            out[c] = (med, iqr if iqr else 1.0)
        return out
    raise ValueError(f"unknown scaling method {method!r}")


def scale_exprs(params: dict) -> dict[str, str]:
    return {c: f"(CAST(`{c}` AS DOUBLE) - {_lit_sql(float(m))}) / {_lit_sql(float(s))}"
            for c, (m, s) in params.items() if m is not None}


def scale(df: DataFrame, cols: Sequence[str], method: str = "standard", fit_on: DataFrame | None = None) -> DataFrame:
    params = fit_scaler(fit_on if fit_on is not None else df, cols, method)
    return apply_exprs(df, scale_exprs(params))


# ---------------------------------------------------------------- F9 / F11 encoding

def fit_categories(df: DataFrame, cols: Sequence[str], max_categories: int | None = None) -> dict[str, list]:
    """Sorted distinct non-null values per column, every one of them. The dictionary goes to the driver; a
    caller may set ``max_categories`` to fail early where that is too much."""
    cols = list(cols)
    if not cols:
        return {}
    if max_categories is not None:
        approx = df.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(cols)]).first()
        too_big = [c for i, c in enumerate(cols) if approx[f"d{i}"] > max_categories * 1.1]
        if too_big:
            raise ValueError(f"columns {too_big} have more than {max_categories} categories; "
                             "drop them or hash them before one-hot encoding")
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in cols])
    rows = df.select(F.inline(pairs)).where(F.col("v").isNotNull()).distinct().collect()
    out: dict[str, list] = {c: [] for c in cols}
    for r in rows:
        out[r["column_name"]].append(r["v"])
    for c in cols:
        out[c].sort()
        if max_categories is not None and len(out[c]) > max_categories:
            raise ValueError(f"column {c} has {len(out[c])} categories > {max_categories}")
    return out


def one_hot_exprs(categories: dict[str, list]) -> dict[str, str]:
    """Dense indicator columns ``{col}_{category}``; unseen values and NULL give all zeros."""
    out = {}
    for c, cats in categories.items():
        for v in cats:
            out[f"{c}_{v}"] = f"CASE WHEN CAST(`{c}` AS STRING) = {_lit_sql(v)} THEN 1.0 ELSE 0.0 END"
    return out


def one_hot_index(df: DataFrame, col: str, categories: list | None = None) -> DataFrame:
    """Sparse form of the one-hot vector: slot index (NULL for unseen / NULL) and size."""
    cats = categories if categories is not None else fit_categories(df, [col])[col]
    mapping = F.create_map(*[x for i, v in enumerate(cats) for x in (F.lit(v), F.lit(i))])
    return df.withColumn(f"{col}_index", mapping[F.col(col).cast("string")]) \
             .withColumn(f"{col}_size", F.lit(len(cats)))


def label_encode(df: DataFrame, col: str, out_col: str | None = None, classes: list | None = None) -> DataFrame:
    """Sorted classes -> 0..k-1 (as string comparison, like a label encoder on object data)."""
    cats = classes if classes is not None else fit_categories(df, [col])[col]
    mapping = F.create_map(*[x for i, v in enumerate(cats) for x in (F.lit(v), F.lit(i))])
    return df.withColumn(out_col or f"{col}_encoded", mapping[F.col(col).cast("string")])


def label_decode(df: DataFrame, col: str, classes: list, out_col: str | None = None) -> DataFrame:
    """encoded -> class via dictionary, default = the code as string."""
    mapping = F.create_map(*[x for i, v in enumerate(classes) for x in (F.lit(i), F.lit(v))])
    return df.withColumn(out_col or f"{col}_decoded",
                         F.coalesce(mapping[F.col(col).cast("int")], F.col(col).cast("string")))


# ---------------------------------------------------------------- F12 / F13 / F14 splits

def split_random(df: DataFrame, id_cols: Sequence[str], test_size: float = 0.2, seed: int = 42,
                 out_col: str = "split") -> DataFrame:
    """Deterministic hash split: a row is 'test' when its md5-derived unit value < test_size.
    Independent of partitioning and of executor retries."""
    return df.withColumn(out_col, F.when(hash_unit(id_cols, seed) < test_size, F.lit("test"))
                         .otherwise(F.lit("train")))


#: Rows of a class that one window task ranks, about (the hash spreads a larger class evenly over buckets).
CUT_ROWS = 1 << 16


def class_cuts(keyed: DataFrame, ranks, cut_rows: int = CUT_ROWS) -> DataFrame:
    """(__k, __cuts): for each class the values of ``__h`` at the places ``ranks(size)`` (from 0; those outside are left out).

    ``keyed`` has a class ``__c`` (NULL is one too) and a hash ``__h`` in [0, 1). A class is cut into equal ranges of the hash
    of about ``cut_rows`` rows; counts tell the ranges that hold a wanted place, and only their rows are ranked. All
    classes are done at once, and they stay a table, whatever their number.
    """
    keyed = keyed.select("__c", "__h")
    sizes = keyed.groupBy(F.col("__c").alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    rows = keyed.join(sizes, F.col("__c").eqNullSafe(F.col("__k"))).select(
        "__k", "__h", F.floor(F.col("__h") * F.ceil(F.col("__n") / F.lit(cut_rows))).alias("__b"))
    counts = rows.groupBy("__k", "__b").agg(F.count(F.lit(1)).alias("__m"))
    until = F.sum("__m").over(Window.partitionBy("__k").orderBy("__b"))
    counts = counts.withColumn("__from", until - F.col("__m"))
    wanted = sizes.select(F.col("__k").alias("__w"), F.explode(ranks(F.col("__n"))).alias("__r"))
    hits = counts.join(wanted, F.col("__k").eqNullSafe(F.col("__w")) & (F.col("__r") >= F.col("__from"))
                       & (F.col("__r") < F.col("__from") + F.col("__m"))).select(
        F.col("__k").alias("__w"), F.col("__b").alias("__wb"), (F.col("__r") - F.col("__from")).alias("__place"))
    same = F.col("__k").eqNullSafe(F.col("__w")) & (F.col("__b") == F.col("__wb"))
    place = F.row_number().over(Window.partitionBy("__k", "__b").orderBy("__h")) - 1
    ranked = rows.join(hits.select("__w", "__wb").distinct(), same, "left_semi").withColumn("__at", place)
    return (ranked.join(hits, same & (F.col("__at") == F.col("__place")))
            .groupBy("__k").agg(F.sort_array(F.collect_list("__h")).alias("__cuts")))


def _with_cuts(df: DataFrame, target: str, id_cols: Sequence[str], seed: int, ranks, cut_rows: int) -> DataFrame:
    keyed = df.withColumns({"__c": F.col(target).cast("string"), "__h": hash_fraction_expr(id_cols, seed)})
    cuts = class_cuts(keyed, ranks, cut_rows)
    return keyed.join(cuts, F.col("__c").eqNullSafe(F.col("__k")), "left")


def split_stratified(df: DataFrame, target: str, id_cols: Sequence[str], test_size: float = 0.2,
                     seed: int = 42, out_col: str = "split", cut_rows: int = CUT_ROWS) -> DataFrame:
    """Per class exactly ceil(test_size * n_class) rows (those with the smallest row hash) go to test; rows without a class to train.

    The cut of every class comes from ``class_cuts``, so no class is ever gathered into one window partition and any
    number of classes splits. Rows of one key stay together, so repeated keys can move a class's count.
    """
    cut = _with_cuts(df, target, id_cols, seed,
                     lambda n: F.filter(F.array(F.ceil(F.lit(float(test_size)) * n) - 1), lambda r: r >= 0), cut_rows)
    return cut.withColumn(out_col, F.when(F.col("__c").isNotNull() & (F.col("__h") <= F.get("__cuts", F.lit(0))), F.lit("test"))
                          .otherwise(F.lit("train"))).drop("__c", "__h", "__k", "__cuts")


def stratified_folds(df: DataFrame, target: str, id_cols: Sequence[str], k: int = 5, seed: int = 42,
                     out_col: str = "fold", cut_rows: int = CUT_ROWS) -> DataFrame:
    """Fold 0..k-1 for cross validation: every fold gets floor(n / k) or ceil(n / k) rows of each class (NULL is a class).

    A class is cut at the places ceil(i * n / k) of its order by row hash. Its first fold is drawn by a hash of its
    name, so that the rest of many small classes doesn't gather in fold 0. Rows of one key share a fold, the one of the last of them.
    """
    places = F.array(*[F.lit(i) for i in range(1, k)]).cast("array<long>")
    cut = _with_cuts(df, target, id_cols, seed, lambda n: F.transform(places, lambda i: F.ceil(i * n / F.lit(k))), cut_rows)
    first = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "__c")), 1, 8), 16, 10).cast("long")
    part = F.size(F.filter(F.coalesce("__cuts", F.array().cast("array<double>")), lambda x: x <= F.col("__h")))
    # in a class of fewer than k rows one row may be at several places
    return cut.withColumn(out_col, ((part + first) % k).cast("int")).drop("__c", "__h", "__k", "__cuts")


def _digits(c, kind) -> list | None:
    """A value of order as numbers that a double holds exactly, most significant first; None for text, whose number is open."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType)):
        return [c.cast("double")]
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        c = F.unix_date(c).cast("long")
    elif isinstance(kind, T.DecimalType):
        whole = (c * F.expr(f"cast(1e{kind.scale} as decimal(38,0))")).cast("decimal(38,0)")
        big, small = F.expr("cast(1e24 as decimal(38,0))"), F.expr("cast(1e12 as decimal(38,0))")
        return [F.floor(whole / big).cast("double"), F.floor(F.pmod(whole, big) / small).cast("double"), F.pmod(whole, small).cast("double")]
    elif not isinstance(kind, T.LongType):
        return None
    return [F.shiftright(c, 32).cast("double"), c.bitwiseAND(0xFFFFFFFF).cast("double")]


def value_at(df: DataFrame, col: str, r: int):
    """The value of ``col`` (NULLs left out) at place ``r`` of its order, in its own type: one exact order statistic for each
    digit of the values, among the rows alike in the digits before. No rows are gathered, however many tie."""
    kind = df.schema[col].dataType
    order = F.col(col).cast("string")
    digits = _digits(F.col(col), kind)
    rows, at = df.where(F.col(col).isNotNull()), 0
    while True:
        if digits is not None:
            if at == len(digits):
                break
            v = digits[at]
        else:   # six bytes of the text at a time
            if rows.agg(F.max(F.octet_length(order))).first()[0] <= 6 * at:
                break
            v = F.conv(F.rpad(F.hex(F.substring(F.encode(order, "UTF-8"), 6 * at + 1, 6)), 12, "0"), 16, 10).cast("double")
        star = order_statistics(rows.select(F.lit("i").alias("column_name"), v.alias("v")), {"i": ("i", r)})["i"]
        r -= rows.where(v < star).count()
        rows, at = rows.where(v == star), at + 1
    return rows.select(col).first()[0]


def split_chronological(df: DataFrame, ts_col: str, id_col: str, train_frac: float = 0.8,
                        out_col: str = "split") -> DataFrame:
    """First floor(train_frac * n) rows in (ts, id) order are 'train', the rest 'test'.

    The boundary row is found as two exact order statistics (the timestamp, then the id
    among rows tied at that timestamp), not by numbering all rows in one partition. Ids that aren't numbers are
    compared in their own type; with the timestamp itself as id, rows tied at the boundary are 'test'.
    """
    ts_num = F.unix_micros(F.col(ts_col).cast("timestamp")).cast("double") if not isinstance(
        df.schema[ts_col].dataType, (T.LongType, T.IntegerType, T.DoubleType)) else F.col(ts_col).cast("double")
    keyed = df.withColumn("__t", ts_num)
    n = keyed.count()
    k = int(math.floor(train_frac * n))
    if k >= n:
        return keyed.drop("__t").withColumn(out_col, F.lit("train"))
    long = keyed.select(F.lit("t").alias("column_name"), F.col("__t").alias("v"))
    t_star = order_statistics(long, {"t": ("t", k)})["t"]
    train = F.col("__t") < t_star
    if id_col != ts_col:
        r = k - keyed.where(train).count()
        ties = keyed.where(F.col("__t") == t_star)
        id_star = value_at(ties, id_col, r)
        train = train | ((F.col("__t") == t_star) & (F.col(id_col) < F.lit(id_star)))
    return keyed.withColumn(out_col, F.when(train, F.lit("train")).otherwise(F.lit("test"))).drop("__t")


# ---------------------------------------------------------------- F16 class weights

def class_weights(df: DataFrame, target: str, out_col: str = "class_weight") -> DataFrame:
    """Balanced weights n / (k * n_c) per class as a small table (class, n_c, weight)."""
    counts = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("cls")).agg(
        F.count(F.lit(1)).alias("n_class"))
    tot = counts.agg(F.sum("n_class").alias("__n"), F.count(F.lit(1)).alias("__k"))
    return attach(counts, tot).select(
        "cls", "n_class", (F.col("__n") / (F.col("__k") * F.col("n_class"))).alias(out_col))


def with_class_weights(df: DataFrame, target: str, out_col: str = "class_weight", fit: DataFrame | None = None) -> DataFrame:
    """Attach to every row the balanced weight of its class, fitted on ``fit`` (the rows themselves if
    not given); adaptive execution broadcasts the class table where it is small."""
    w = class_weights(df if fit is None else fit, target, out_col).withColumnRenamed("cls", target).drop("n_class")
    return df.join(w, target, "left")


# ---------------------------------------------------------------- F10 composition

def to_sql_transformer(exprs: dict[str, str], columns: Sequence[str]):
    """Persistable ML stage applying a fitted projection (for PipelineModel save/load)."""
    from pyspark.ml.feature import SQLTransformer
    sel = []
    for c in columns:
        sel.append(f"{exprs[c]} AS `{c}`" if c in exprs else f"`{c}`")
    for c, e in exprs.items():
        if c not in columns:
            sel.append(f"{e} AS `{c}`")
    return SQLTransformer(statement="SELECT " + ", ".join(sel) + " FROM __THIS__")


def numeric_and_categorical(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str], list[str]]:
    t = column_types(df, exclude)
    return t["numeric"] + t["boolean"], t["categorical"], t["datetime"]
