"""Every registered query against its SQL on the smallest tables."""

import pytest
from harness import compare

from changeloom.catalog import load

QUERIES, ORACLES = load()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, small_dir, small_duckdb, name):
    problem, _, _ = compare(spark, small_duckdb, small_dir, QUERIES[name], ORACLES.get(name))
    assert problem is None, problem


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLES)
