"""The whole job on the golden inputs: published values, invariants, bytes on disk."""

import json
import math

from pyspark.sql import functions as F

from tests import golden
from tests.conftest import RUN_TS
from wattfold.operators import lp_summary
from wattfold.schemas import REPORT

# Fixed value: the published stamp.
STAMP = "2025-07-09T23:09:19.679137"


def test_customer_section(golden_run):
    section = golden_run[1].customer_summary
    assert section.total_customers == golden.CUSTOMERS
    assert section.contract_types == golden.CONTRACT_TYPES
    assert section.usage_types == golden.USAGE_TYPES


def test_readings_section(golden_run):
    section = golden_run[1].lp_data_summary
    assert section.total_records == golden.READINGS
    assert section.total_customers == golden.METERED_CUSTOMERS
    assert tuple(section.date_range) == (golden.START, golden.END)
    assert math.isclose(section.avg_power, golden.AVG_POWER, abs_tol=1e-9)


def test_sum_is_exact(readings):
    total = readings.agg(F.sum(F.col("power").cast("decimal(10,1)"))).first()[0]
    assert str(total) == "3090748.2"


def test_one_scan_gives_the_same(readings):
    one, two = (lp_summary(readings, one_scan=x).first() for x in (True, False))
    assert one[:4] == two[:4]
    assert math.isclose(one.avg_power, two.avg_power, abs_tol=1e-9)


def test_fixed_values_and_stamp(golden_run):
    report = golden_run[1]
    files, metadata = report.processed_lp_data.file_info, report.metadata
    assert files.csv_file == "processed_lp_data.csv"
    assert files.parquet_file == "processed_lp_data.parquet"
    assert files.parquet_available is True
    assert files.encoding == "utf-8-sig"
    assert metadata.analysis_stage == "step1_preprocessing_optimized"
    assert metadata.version == "2.0"
    assert metadata.timestamp == RUN_TS.isoformat() == STAMP


def test_invariants(golden_run):
    customers, lp, processed, metadata = golden_run[1]
    assert sum(customers.contract_types.values()) == customers.total_customers
    assert sum(customers.usage_types.values()) == customers.total_customers
    assert processed[:3] == lp[:3]
    assert metadata.total_customers == customers.total_customers
    assert metadata.total_lp_records == lp.total_records
    assert processed.processed_timestamp == metadata.timestamp
    assert lp.date_range.start <= lp.date_range.end


def test_sizes_are_those_on_disk(golden_run):
    out, report = golden_run
    files = report.processed_lp_data.file_info
    for name, gib in (
        (files.csv_file, files.csv_size_gb),
        (files.parquet_file, files.parquet_size_gb),
    ):
        n_bytes = sum(p.stat().st_size for p in (out / name).glob("part-*"))
        assert gib * 1024**3 == n_bytes > 0


def test_report_text(golden_run):
    parts = [p for p in (golden_run[0] / "report.json").glob("part-*")]
    text = parts[0].read_text(encoding="utf-8")
    assert len(parts) == 1
    assert "322 산업용(갑)‖고압A" in text and "\\u" not in text
    report = json.loads(text)
    assert list(report) == [f.name for f in REPORT]
    # Python gets a map column in no order; the text has the largest label first.
    section = report["customer_summary"]
    assert list(section["contract_types"].items()) == list(golden.CONTRACT_TYPES.items())
    assert list(section["usage_types"].items()) == list(golden.USAGE_TYPES.items())


def test_report_schema_is_the_declared_one(spark, customers, readings, tmp_path):
    from wattfold.plans import build_report

    def shape(t):
        return json.loads(
            json.dumps(t.jsonValue()).replace('"nullable": false', '"nullable": true').replace(
                '"valueContainsNull": false', '"valueContainsNull": true'
            )
        )

    report = build_report(customers, readings, str(tmp_path), RUN_TS)
    assert shape(report.schema) == shape(REPORT)


def test_pretty_printed_report_reads_the_same(spark, golden_run, tmp_path):
    from wattfold.sources import read_report

    text = next((golden_run[0] / "report.json").glob("part-*")).read_text(encoding="utf-8")
    pretty = tmp_path / "pretty.json"
    pretty.write_text(json.dumps(json.loads(text), ensure_ascii=False, indent=2), "utf-8")
    assert read_report(spark, str(pretty)).first() == golden_run[1]
