from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wattfold.functions import iso_micros_text
from wattfold.operators import (
    category_map,
    dataset_size_gib,
    dataset_state,
    distinct_count,
    label_counts,
    lp_measures,
    lp_summary,
    lp_summary_of,
    side_by_side,
)
from wattfold.sinks import write_csv_bom, write_parquet

# Fixed values of the report.
CSV_FILE = "processed_lp_data.csv"
PARQUET_FILE = "processed_lp_data.parquet"
ENCODING = "utf-8-sig"
ANALYSIS_STAGE = "step1_preprocessing_optimized"
VERSION = "2.0"


# Keys of the long report and the summary columns they show.
_COUNTS_AND_DATES = {
    "total_records": "total_records",
    "total_customers": "total_customers",
    "date_range.start": "start_ts",
    "date_range.end": "end_ts",
}


def run_stamp(run_ts: datetime) -> Column:
    """The run's one timestamp as text. It is a parameter, so all sections agree on it."""
    if run_ts.tzinfo is not None:
        raise ValueError("run_ts must have no time zone")
    return iso_micros_text(F.lit(run_ts.isoformat(sep=" ")).cast("timestamp_ntz"))


def customer_summary(customers: DataFrame) -> DataFrame:
    """One row: distinct customers and the two histograms as ordered maps.

    Each part scans one column of the master.
    """
    return side_by_side(
        distinct_count(customers, "customer_id", "total_customers"),
        category_map(customers, "contract_type", "contract_types"),
        category_map(customers, "usage_type", "usage_types"),
    )


def lp_data_summary(lp: DataFrame, measures: dict | None = None) -> DataFrame:
    """One row: the readings section of the report.

    ``measures`` are those that a write of the readings has taken on its way.
    """
    summary = lp_summary(lp) if measures is None else lp_summary_of(lp, measures)
    return summary.select("total_records", "total_customers", _date_range(), "avg_power")


def write_processed(lp: DataFrame, out_dir: str) -> DataFrame:
    """Writes the readings as Parquet and as CSV; returns what the Parquet holds.

    The CSV is made from the written Parquet: the two need one read of the source, and
    they hold the same rows whatever the source does meanwhile.
    """
    write_parquet(lp, f"{out_dir}/{PARQUET_FILE}")
    processed = lp.sparkSession.read.schema(lp.schema).parquet(f"{out_dir}/{PARQUET_FILE}")
    write_csv_bom(processed, f"{out_dir}/{CSV_FILE}")
    return processed


def file_info(spark: SparkSession, csv_path: str, parquet_path: str) -> DataFrame:
    """One row: names, sizes and encoding of the two outputs."""
    csv = dataset_size_gib(spark, csv_path).select(F.col("size_gib").alias("csv_size_gb"))
    parquet = dataset_state(spark, parquet_path)
    return side_by_side(csv, parquet).select(
        F.lit(_last_part(csv_path)).alias("csv_file"),
        "csv_size_gb",
        F.lit(_last_part(parquet_path)).alias("parquet_file"),
        F.col("size_gib").alias("parquet_size_gb"),
        F.col("available").alias("parquet_available"),
        F.lit(ENCODING).alias("encoding"),
    )


def processed_summary(
    processed: DataFrame, csv_path: str, parquet_path: str, run_ts: datetime
) -> DataFrame:
    """One row: the section on the written readings. It has no mean."""
    files = file_info(processed.sparkSession, csv_path, parquet_path)
    return side_by_side(
        lp_summary(processed, with_average=False), _section(files, "file_info")
    ).select(
        "total_records",
        "total_customers",
        _date_range(),
        "file_info",
        run_stamp(run_ts).alias("processed_timestamp"),
    )


def run_metadata(
    run_ts: datetime,
    total_customers: Column,
    total_lp_records: Column,
    stage: str = ANALYSIS_STAGE,
    version: str = VERSION,
) -> Column:
    """The run stamp; the two totals come from the other sections."""
    return F.struct(
        run_stamp(run_ts).alias("timestamp"),
        F.lit(stage).alias("analysis_stage"),
        F.lit(version).alias("version"),
        total_customers.alias("total_customers"),
        total_lp_records.alias("total_lp_records"),
    )


def build_report(
    customers: DataFrame,
    lp: DataFrame,
    out_dir: str,
    run_ts: datetime,
) -> DataFrame:
    """Writes the processed readings under ``out_dir`` and returns the report's one row.

    The Parquet write looks at every reading, so it also takes the counts, the range and
    the sum for the section on the source; a task that is repeated counts once. The source
    is read a second time for the distinct customers alone.
    """
    seen = Observation()
    processed = write_processed(lp.observe(seen, *lp_measures()), out_dir)
    written = processed_summary(
        processed, f"{out_dir}/{CSV_FILE}", f"{out_dir}/{PARQUET_FILE}", run_ts
    )
    sections = side_by_side(
        _section(customer_summary(customers), "customer_summary"),
        _section(lp_data_summary(lp, seen.get), "lp_data_summary"),
        _section(written, "processed_lp_data"),
    )
    return sections.withColumn(
        "metadata",
        run_metadata(
            run_ts,
            F.col("customer_summary.total_customers"),
            F.col("lp_data_summary.total_records"),
        ),
    )


def report_long(customers: DataFrame, lp: DataFrame, processed: DataFrame) -> DataFrame:
    """What the report counts, as (section, key, value) rows with values as text.

    File sizes and stamps are left out. The histograms stay rows all the way, so the
    number of labels does not matter here.
    """
    mean = F.round("avg_power", 6)
    parts = [
        _long(
            distinct_count(customers, "customer_id", "n"),
            customer_summary={"total_customers": "n"},
            metadata={"total_customers": "n"},
        ),
        _long_counts(customers, "contract_type", "contract_types"),
        _long_counts(customers, "usage_type", "usage_types"),
        _long(
            lp_summary(lp),
            lp_data_summary={**_COUNTS_AND_DATES, "avg_power": mean},
            metadata={"total_lp_records": "total_records"},
        ),
        _long(lp_summary(processed, False), processed_lp_data=_COUNTS_AND_DATES),
    ]
    return reduce(DataFrame.unionByName, parts)


def _long(one_row: DataFrame, **sections: dict[str, str | Column]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(section).alias("section"),
            F.lit(key).alias("key"),
            (F.col(value) if isinstance(value, str) else value).cast("string").alias("value"),
        )
        for section, values in sections.items()
        for key, value in values.items()
    ]
    return one_row.select(F.inline(F.array(*rows)))


def _long_counts(df: DataFrame, column: str, section: str) -> DataFrame:
    return label_counts(df, column, "n_rows").select(
        F.lit(section).alias("section"),
        F.col(column).cast("string").alias("key"),
        F.col("n_rows").cast("string").alias("value"),
    )


def _section(one_row: DataFrame, name: str) -> DataFrame:
    return one_row.select(F.struct("*").alias(name))


def _date_range() -> Column:
    return F.struct(F.col("start_ts").alias("start"), F.col("end_ts").alias("end")).alias(
        "date_range"
    )


def _last_part(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]
