"""Every registered query against its SQL twin, on whole tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from __spark_entry__ import _own_oracle_sql as oracle_sql
from __spark_entry__ import _own_queries as queries
from __spark_entry__ import entry

SCALES = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]



def duckdb_tables(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def test_every_query_is_checked():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("sf_dir", SCALES)
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, name, sf_dir):
    df = queries()[name](spark, sf_dir)
    want = duckdb_tables(sf_dir).sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert multiset(df.columns, df.collect()) == multiset(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["contract_counts", "usage_counts", "codelabel_counts"])
def test_order_and_ties(spark, name):
    rows = [tuple(r) for r in queries()[name](spark, SCALES[1]).collect()]
    assert rows == duckdb_tables(SCALES[1]).sql(oracle_sql()[name]).fetchall()


def test_entry(spark):
    row = entry(spark).first()
    assert (row.total_records, row.start_ts < row.end_ts) == (1000, True)
    assert math.isclose(row.avg_power, 50.05019, abs_tol=1e-6)
