"""Queries against their SQL, on whole tables."""

import pytest

from tests.test_queries import duckdb_tables, multiset
from wattfold.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, name, sf_dir):
    df = queries()[name](spark, sf_dir)
    want = duckdb_tables(sf_dir).sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert multiset(df.columns, df.collect()) == multiset(want.columns, want.fetchall())
