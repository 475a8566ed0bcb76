"""Readers. Each takes an explicit schema and makes one scan."""

from wattfold.sources.tables import (
    as_customers,
    as_readings,
    read_csv,
    read_customers,
    read_lp,
    read_report,
)

__all__ = [
    "as_customers",
    "as_readings",
    "read_csv",
    "read_customers",
    "read_lp",
    "read_report",
]
