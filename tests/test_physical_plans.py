"""The plans have the shape that was chosen for them."""

import re

import pytest

from __spark_entry__ import _own_oracle_sql as oracle_sql
from __spark_entry__ import _own_queries as queries
from wattfold.operators import (
    category_counts,
    category_map,
    dataset_size_gib,
    lp_summary,
    lp_summary_of,
)
from wattfold.sinks import write_csv_bom, write_parquet
from wattfold.sources import read_csv, read_lp

SF_DIR = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def scans(df):
    return re.findall(r"ReadSchema: (struct<.*>)", plan(df))


@pytest.fixture
def stored(spark, readings, tmp_path):
    write_parquet(readings, str(tmp_path / "lp"))
    return read_lp(spark, str(tmp_path / "lp"), schema=readings.schema)


def test_summary_scans_disjoint_columns(stored):
    df = lp_summary(stored)
    assert sorted(scans(df)) == [
        "struct<customer_id:string>",
        "struct<ts:timestamp_ntz,power:double>",
    ]
    # The one hash shuffle carries ids that are already distinct per task.
    assert len(re.findall("hashpartitioning", plan(df))) == 1
    assert re.search(r"Input \[1\]: \[customer_id#\d+\]\nArguments: hashpartitioning", plan(df))


def test_processed_summary_reads_no_power(stored):
    assert "power" not in "".join(scans(lp_summary(stored, with_average=False)))


def test_one_scan_is_one_scan(stored):
    assert len(scans(lp_summary(stored, one_scan=True))) == 1


def test_counts_are_partial_before_the_shuffle(stored):
    text = plan(category_counts(stored, "customer_id"))
    assert scans(category_counts(stored, "customer_id")) == ["struct<customer_id:string>"]
    assert text.index("partial_count") < text.index("hashpartitioning")


def test_map_is_one_aggregate_of_counts(stored):
    text = plan(category_map(stored, "customer_id", "m"))
    assert len(re.findall("hashpartitioning", text)) == 1
    assert text.index("partial_count") < text.index("hashpartitioning")


def test_summary_of_a_write_shuffles_bare_ids(spark, readings, tmp_path):
    write_csv_bom(readings, str(tmp_path / "lp"))
    df = lp_summary_of(read_csv(spark, str(tmp_path / "lp"), schema=readings.schema), {})
    text = plan(df)
    assert len(re.findall("hashpartitioning", text)) == 1
    assert re.search(r"Input \[1\]: \[customer_id#\d+\]\nArguments: hashpartitioning", text)


def test_sizes_open_no_file(spark, stored):
    df = dataset_size_gib(spark, stored.inputFiles()[0].rsplit("/", 1)[0])
    assert scans(df) == ["struct<length:bigint>"]


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_join_no_python_no_cap(spark, name):
    text = plan(queries()[name](spark, SF_DIR))
    operators = ("Join", "Cartesian", "Python", "Limit", "TakeOrdered", "Sample", "raise_error")
    for operator in operators:
        assert operator not in text
    assert oracle_sql().get(name, "").lower().count(" limit ") == 0
