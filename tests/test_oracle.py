"""Every registered query with an oracle matches DuckDB on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from tools.oracle_check import TABLES, compare

SF = "/root/testdata/sf0.001"
NAMES = sorted(oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = queries()[name](spark, SF).toPandas()
    exp = con.execute(oracle_sql()[name]).df()
    assert compare(got, exp) is None
