"""Every registered query with SQL against DuckDB, and the entry module."""

from __future__ import annotations

import pytest

import __spark_entry__
from lexispark.plans.registry import QUERIES, SQL
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    same_rows(spark, QUERIES[name](spark, sf), SQL[name], sf)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 80
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
