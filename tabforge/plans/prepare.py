"""Column-wise preparation fitted on the training rows only (F10), as a persistable
``PipelineModel``: one SQL projection (datetime features, imputation, clipping, scaling,
boolean casts), then string indexing + one-hot for categoricals, then vector assembly.

Every fit is one aggregate over the training split; the transform is a projection that
stays in whole-stage codegen.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, functions as F, types as T

from tabforge.functions import dates as D
from tabforge.operators import prepare as R
from tabforge.operators.profile import column_types
from tabforge.operators.timefeatures import date_strings

# The reference's default preparation settings.
DEFAULT_CONFIG = {
    "preprocessing": {
        "outlier_detection": {"method": "iqr", "threshold": 1.5, "strategy": "clip"},
        "missing_values": {"numeric_strategy": "mean", "categorical_strategy": "most_frequent"},
    },
    "feature_engineering": {"scaling": "standard"},
    "train_test_split": {"test_size": 0.2, "random_state": 42, "stratify": True},
}


def merged_config(base: dict | None, override: dict | None = None) -> dict:
    """Deep merge without mutating either input (the defaults stay intact)."""
    out = copy.deepcopy(base if base is not None else DEFAULT_CONFIG)
    for k, v in (override or {}).items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merged_config(out[k], v)
        else:
            out[k] = copy.deepcopy(v)
    return out


@dataclass
class Prepared:
    model: PipelineModel
    numeric: list[str]
    categorical: list[str]
    datetime: list[str]
    slot_names: list[str]
    params: dict = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)
    label_classes: list | None = None


def _lit(v):
    return R._lit_sql(v)


def fit_preparation(train: DataFrame, target: str | None, cfg: dict | None = None, exclude=(),
                    problem: str = "regression", max_categories: int | None = None,
                    label_col: str = "label", features_col: str = "features") -> Prepared:
    """Fit the preparation on ``train`` and return the fitted pipeline and slot names."""
    cfg = merged_config(DEFAULT_CONFIG, cfg)
    pp = cfg["preprocessing"]
    skip = set(exclude) | ({target} if target else set())
    types = column_types(train, skip)
    numeric, categorical, dts, booleans = types["numeric"], types["categorical"], types["datetime"], types["boolean"]

    # 0. strings that are all dates become timestamps
    dated = date_strings(train, [c for c in categorical if isinstance(train.schema[c].dataType, T.StringType)])
    before = []
    if dated:
        before = [SQLTransformer(statement="SELECT * EXCEPT (" + ", ".join(f"`{c}`" for c in dated) + "), "
                                 + ", ".join(f"try_to_timestamp(`{c}`) AS `{c}`" for c in dated) + " FROM __THIS__")]
        train = before[0].transform(train)
        categorical, dts = [c for c in categorical if c not in dated], [*dts, *dated]

    # 1. datetime columns become numeric features (not one-hot categories). Hour / minute
    # columns exist only when some value has a time of day; the flag comes from the same
    # fused first pass as the column statistics below.
    dt_all: dict[str, str] = {}
    for c in dts:
        dt_all.update(D.datetime_feature_sql(c, True))
    dt_all = {k: (f"CAST({v} AS DOUBLE)" if k.endswith(("is_weekend", "is_month_end")) else v) for k, v in dt_all.items()}
    stage_all = dict(dt_all)
    for b in booleans:
        stage_all[b] = f"CAST(`{b}` AS DOUBLE)"
    cand = numeric + booleans + list(dt_all)
    base_all = R.apply_exprs(train.select(*(numeric + booleans + dts + categorical)), stage_all)

    # One pass: row count, per numeric column mean / min / max, hour flags, category counts.
    def _v(c):
        x = F.col(f"`{c}`").cast("double")
        return F.when(~F.isnan(x), x)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cand):
        aggs += [F.avg(_v(c)).alias(f"a{i}"), F.min(_v(c)).alias(f"l{i}"), F.max(_v(c)).alias(f"h{i}")]
    for i, c in enumerate(dts):
        aggs.append(F.max(F.hour(F.col(f"`{c}`"))).alias(f"t{i}"))
    for i, c in enumerate(categorical):
        aggs.append(F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}"))
    first = base_all.agg(*aggs).first()
    flags = {c: (first[f"t{i}"] or 0) > 0 for i, c in enumerate(dts)}
    dt_sql: dict[str, str] = {}
    for c in dts:
        names = set(D.datetime_feature_sql(c, flags[c]))
        dt_sql.update({k: v for k, v in dt_all.items() if k in names})
    stage1_sql = {k: v for k, v in stage_all.items() if k in dt_sql or k in booleans}
    num_all = numeric + booleans + list(dt_sql)
    idx_of = {c: i for i, c in enumerate(cand)}
    n_rows = first["__n"]

    # Fits happen on the projected training rows, one aggregate each. Every pass re-scans only
    # the needed Parquet columns (pruned, cheap) instead of persisting a copy of the table.
    base = R.apply_exprs(train.select(*(numeric + booleans + dts)), stage1_sql).select(*num_all)
    strategy = pp["missing_values"].get("numeric_strategy", "mean")
    if strategy == "mean":
        fills = {c: first[f"a{idx_of[c]}"] for c in num_all}
    else:
        fills = R.fit_imputer(base, num_all, strategy)
    imp = R.impute_exprs(base, fills)
    cur = R.apply_exprs(base, imp)
    od = pp["outlier_detection"]
    bounds = {}
    if od.get("strategy", "clip") != "none":
        # after imputation every value is present; the fill lies inside [min, max] unless it is
        # a constant, so the first pass already gives the quantile solver its start window
        stats = {}
        for c in num_all:
            lo, hi, f = first[f"l{idx_of[c]}"], first[f"h{idx_of[c]}"], fills.get(c)
            if lo is None:
                stats[c] = (n_rows if f is not None else 0, f, f)
            else:
                if isinstance(f, (int, float)):
                    lo, hi = min(lo, f), max(hi, f)
                stats[c] = (n_rows, lo, hi) if f is not None else None
        if od.get("method", "iqr") == "iqr" and all(v is not None for v in stats.values()):
            from tabforge.operators.quantiles import exact_quantiles
            q = exact_quantiles(cur, num_all, (0.25, 0.75), stats=stats)
            t = od.get("threshold", 1.5)
            for c in num_all:
                q1, q3 = q[(c, 0.25)], q[(c, 0.75)]
                bounds[c] = (None, None) if q1 is None else (q1 - t * (q3 - q1), q3 + t * (q3 - q1))
        else:
            bounds = R.outlier_bounds(cur, num_all, od.get("method", "iqr"), od.get("threshold", 1.5))
    clip = {}
    if od.get("strategy") == "clip":
        clip = R.clip_exprs(bounds)
        cur = R.apply_exprs(cur, clip)
    elif od.get("strategy") == "remove":
        cur = R.apply_outliers(cur, bounds, "remove")      # training rows only; scoring keeps all rows
    method = cfg["feature_engineering"].get("scaling", "standard")
    if method not in ("standard", "minmax", "robust", "none"):
        raise ValueError(f"unknown scaling {method!r}")
    scaler = R.fit_scaler(cur, num_all, method)

    # compose numeric expressions: scale(clip(impute(x)))
    num_sql = {}
    for c in num_all:
        e = stage1_sql.get(c, f"`{c}`")
        if c in fills and fills[c] is not None:
            e = f"CASE WHEN ({e}) IS NULL OR isnan(CAST(({e}) AS DOUBLE)) THEN {_lit(float(fills[c]))} ELSE CAST(({e}) AS DOUBLE) END"
        else:
            e = f"CAST(({e}) AS DOUBLE)"
        if c in clip:
            lo, hi = bounds[c]
            e = f"CASE WHEN ({e}) < {_lit(float(lo))} THEN {_lit(float(lo))} WHEN ({e}) > {_lit(float(hi))} THEN {_lit(float(hi))} ELSE ({e}) END"
        if c in scaler and scaler[c][0] is not None:
            m, s = scaler[c]
            e = f"(({e}) - {_lit(float(m))}) / {_lit(float(s))}"
        num_sql[f"{c}__num"] = f"CAST(({e}) AS DOUBLE)"

    # 2. categoricals: most-frequent imputation, then index + one-hot (unknown -> all zeros)
    dropped = []
    if categorical:
        keep = []
        for i, c in enumerate(categorical):
            (dropped if max_categories is not None and first[f"d{i}"] > max_categories else keep).append(c)
        categorical = keep
    cat_fills = R.fit_imputer(train, categorical, pp["missing_values"].get("categorical_strategy", "most_frequent"))
    cat_sql = {}
    for c in categorical:
        f = cat_fills.get(c)
        cat_sql[f"{c}__cat"] = (f"coalesce(CAST(`{c}` AS STRING), {_lit(str(f))})" if f is not None
                                else f"CAST(`{c}` AS STRING)")
    label_sql = {}
    label_classes = None
    if target and problem in ("regression", "time_series"):
        label_sql[label_col] = f"CAST(`{target}` AS DOUBLE)"
    elif target and problem == "classification":
        numeric_target = isinstance(train.schema[target].dataType, (T.NumericType, T.BooleanType))
        # the class's text is Spark's own cast, which the CASE below compares with
        pairs = [tuple(r) for r in train.where(F.col(target).isNotNull()).select(
            F.col(target), F.col(target).cast("string").alias("text")).distinct().collect()]
        pairs = sorted(pairs, key=lambda p: p[0] if numeric_target else p[1])
        vals = [text for _, text in pairs]
        label_classes = [v for v, _ in pairs] if numeric_target else vals
        # sorted classes -> 0..k-1 as a plain CASE (no ML attribute metadata, so binary models
        # see exactly two classes); an unseen class at scoring time gets a NULL label
        whens = " ".join(f"WHEN {_lit(str(v))} THEN {float(i)}" for i, v in enumerate(vals))
        label_sql[label_col] = f"CASE CAST(`{target}` AS STRING) {whens} ELSE NULL END"
    # pass every input column through, so scoring tables with other extra columns work too
    # but for one whose name the prepared columns take
    taken = [c for c in (label_col, features_col) if c in train.columns]
    select = ["* EXCEPT (" + ", ".join(f"`{c}`" for c in taken) + ")" if taken else "*"] + [f"{e} AS `{k}`" for k, e in {**num_sql, **cat_sql, **label_sql}.items()]
    sqlt = SQLTransformer(statement="SELECT " + ", ".join(select) + " FROM __THIS__")
    stages = [*before, sqlt]
    projected = sqlt.transform(train)
    vec_inputs = list(num_sql)
    slot_names = [k[:-5] for k in num_sql]
    if categorical:
        idx = StringIndexer(inputCols=list(cat_sql), outputCols=[f"{c}__idx" for c in categorical],
                            stringOrderType="alphabetAsc", handleInvalid="keep").fit(projected)
        ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in categorical], outputCols=[f"{c}__ohe" for c in categorical],
                            dropLast=True, handleInvalid="keep").fit(idx.transform(projected))
        stages += [idx, ohe]
        vec_inputs += [f"{c}__ohe" for c in categorical]
        for c, labels in zip(categorical, idx.labelsArray):
            slot_names += [f"{c}_{v}" for v in labels]
    stages.append(VectorAssembler(inputCols=vec_inputs, outputCol=features_col, handleInvalid="keep"))
    model = PipelineModel(stages)
    params = {"fills": fills, "bounds": bounds, "scaler": scaler, "categorical_fills": cat_fills,
              "scaling": method, "outliers": od}
    return Prepared(model, numeric + booleans, categorical, dts, slot_names, params, dropped, label_classes)


def training_rows(prep: Prepared, train: DataFrame) -> DataFrame:
    """Training rows after the 'remove' outlier strategy (scoring never drops rows)."""
    od = prep.params["outliers"]
    if od.get("strategy") != "remove":
        return train
    # removal is applied to the raw numeric columns with the fitted bounds
    raw_bounds = {c: b for c, b in prep.params["bounds"].items() if c in train.columns}
    return R.apply_outliers(train, raw_bounds, "remove")
