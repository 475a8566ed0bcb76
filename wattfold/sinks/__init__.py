"""Writers. The two table writers are map-only: no shuffle, one file per task."""

from wattfold.sinks.files import remove, write_csv_bom, write_parquet, write_report

__all__ = ["remove", "write_csv_bom", "write_parquet", "write_report"]
