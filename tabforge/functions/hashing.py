"""Deterministic row hashing for splits and samples (replaces seeded RNG draws).

A value derived from md5 of the row key is the same in every engine, on every
partitioning and on every task retry, which a ``rand()`` draw is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def _key(id_cols: Sequence[str], seed) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_cols])


def hash_hex(id_cols: Sequence[str], seed=42) -> Column:
    return F.md5(_key(id_cols, seed))


def hash_unit(id_cols: Sequence[str], seed=42) -> Column:
    """Uniform value in [0, 1) from the first 32 bits of md5('seed|id...')."""
    return F.conv(F.substring(hash_hex(id_cols, seed), 1, 8), 16, 10).cast("double") / 4294967296.0


def hash_fraction_expr(id_cols: Sequence[str], seed=42) -> Column:
    """Finer value in [0, 1) from 52 bits (exact in a double), used for ranking."""
    return F.conv(F.substring(hash_hex(id_cols, seed), 1, 13), 16, 10).cast("double") / 4503599627370496.0


def hash_fold(id_cols: Sequence[str], k: int, seed=42) -> Column:
    """Fold number 0..k-1 for k-fold cross validation."""
    return (F.conv(F.substring(hash_hex(id_cols, seed), 1, 8), 16, 10).cast("long") % k).cast("int")
