"""Registered queries against DuckDB on the smallest tables; model queries only have to give rows."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# fits of many models; run by the driver and by oracle_check
SLOW = {"m2_ridge", "m3_logistic_regression", "m4_random_forest", "m5_gradient_boosting", "m5_gradient_boosting_multiclass", "m8_cross_val_score",
        "m14_stacking", "f9_recursive_elimination", "select_features", "m18_concurrent_candidates", "m9_search", "u2_stream_score", "m9_deadline_search", "m14_stack_scores"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, con, sf, name):
    if name in SQL:
        problem = compare(spark, con, name, QUERIES[name], SQL[name], sf)
        if problem == "both sides are empty":
            return
        assert problem == ""
    else:
        assert QUERIES[name](spark, sf).count() > 0
