"""Every registered query against its DuckDB oracle on the smallest test tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracles import TABLES, compare, compare_types  # noqa: E402

from shredkit import registry  # noqa: E402


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_oracle(spark, duck, sf_small, name):
    sql = entry.oracle_sql().get(name)
    df = entry.queries()[name](spark, sf_small)
    assert sql is not None, f"{name} has no oracle"
    err = compare(df.toPandas(), duck.execute(sql).df()) or compare_types(df, duck, sql)
    assert err is None, err


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "content_hash_id" in df.columns
