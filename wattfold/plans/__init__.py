"""Whole results: the sections of the report and the job that makes them."""

from wattfold.plans.report import (
    CSV_FILE,
    ENCODING,
    PARQUET_FILE,
    build_report,
    customer_summary,
    file_info,
    lp_data_summary,
    processed_summary,
    report_long,
    run_metadata,
    write_processed,
)

__all__ = [
    "CSV_FILE",
    "ENCODING",
    "PARQUET_FILE",
    "build_report",
    "customer_summary",
    "file_info",
    "lp_data_summary",
    "processed_summary",
    "report_long",
    "run_metadata",
    "write_processed",
]
