"""Scalar-subquery helper: attach a one-row aggregate to every row as literals.

Used wherever a per-row expression needs a table-level total (shares, thresholds): the
one-row aggregate is evaluated once and inlined, instead of a cross join with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    row = one_row.first()
    if row is None:
        raise ValueError("scalar aggregate returned no row")
    return df.select("*", *[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in one_row.schema.fields])
