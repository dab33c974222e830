"""Exact distributed quantiles equal numpy's linear interpolation, including when the
histogram refinement needs several rounds (tiny ``final_rows``)."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tabforge.operators.quantiles import exact_quantiles, order_statistics, long_values

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def _check(spark, values, final_rows):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = exact_quantiles(df, ["x"], PROBS, bins=8, final_rows=final_rows)
    for p in PROBS:
        assert got[("x", p)] == pytest.approx(float(np.quantile(values, p)), rel=1e-12, abs=1e-12)


def test_refinement_many_rounds(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(0, 1, 3000), rng.exponential(50, 1000), [1e9, -1e9]])
    _check(spark, values, final_rows=5)


def test_duplicates_and_even_counts(spark):
    _check(spark, [1, 2, 3, 4], final_rows=1)
    _check(spark, [5] * 100 + [1, 9], final_rows=3)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=60))
def test_property(spark, values):
    _check(spark, values, final_rows=4)


def test_nulls_and_nan_are_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    assert exact_quantiles(df, ["x"], (0.5,))[("x", 0.5)] == 2.0


def test_order_statistics_per_group(spark):
    rows = [("a", float(i)) for i in range(10)] + [("b", float(-i)) for i in range(5)]
    long = spark.createDataFrame(rows, "column_name string, v double")
    got = order_statistics(long, {"a3": ("a", 3), "b0": ("b", 0)}, final_rows=2, bins=4)
    assert got == {"a3": 3.0, "b0": -4.0}
