"""Queries that SQL can express, against their SQL; and that every query is registered."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))

from check_oracles import TABLES, compare  # noqa: E402

import corpus_pipeline  # noqa: E402


def test_all_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14))
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(corpus_pipeline.oracle_sql()))
def test_query_matches_sql(spark, sf_small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    got = corpus_pipeline.queries()[name](spark, sf_small).toPandas()
    assert len(got)
    assert compare(got, con.execute(corpus_pipeline.oracle_sql()[name]).df()) is None
