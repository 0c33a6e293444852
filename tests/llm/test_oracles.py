"""Queries of the subpackage that SQL can express, against DuckDB."""

import pytest
from oracle_check import compare, duck

from tabloom.llm.queries import QUERIES, SQL


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, name):
    assert compare(spark, duck(sf), name, QUERIES[name], SQL[name], sf) == ""
