"""Queries that SQL can express, against DuckDB."""

import pytest

from bookspark.llm import queries as Q


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_same_as_sql(spark, tiny, same_as_sql, name):
    same_as_sql(spark, tiny, Q.queries()[name], Q.oracle_sql()[name])


def test_numbers_are_registered_once():
    names = list(Q.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
