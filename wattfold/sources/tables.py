from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from wattfold.schemas import CUSTOMERS, READINGS, REPORT

# A malformed row stops the read instead of turning into nulls, and the header must
# carry the schema's names, so reordered columns cannot be taken for one another.
# Without a timestamp pattern the reader takes any fraction up to microseconds. With the
# default nullValue, an empty text could not be told from a null: the parser turns an
# empty field into nullValue, so it is set to a character that no text holds.
CSV_READ_OPTIONS = {
    "header": "true",
    "encoding": "UTF-8",
    "escape": '"',
    "nullValue": "\u0000",
    "mode": "FAILFAST",
    "enforceSchema": "false",
}


def _read(
    spark: SparkSession,
    paths: str | Sequence[str],
    fmt: str,
    schema: StructType | str,
    options: dict[str, str],
) -> DataFrame:
    base = CSV_READ_OPTIONS if fmt == "csv" else {}
    paths = paths if isinstance(paths, str) else list(paths)
    return spark.read.format(fmt).schema(schema).options(**{**base, **options}).load(paths)


def read_customers(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str = "parquet",
    schema: StructType | str = CUSTOMERS,
    **options: str,
) -> DataFrame:
    """The customer master, one row per customer."""
    return _read(spark, path, fmt, schema, options)


def read_lp(
    spark: SparkSession,
    paths: str | Sequence[str],
    fmt: str = "parquet",
    schema: StructType | str = READINGS,
    **options: str,
) -> DataFrame:
    """Load-profile readings. Several paths make one scan, not a union."""
    return _read(spark, paths, fmt, schema, options)


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str, **options: str
) -> DataFrame:
    """CSV as ``write_csv_bom`` writes it; the byte-order mark is not part of the data.

    Values with line breaks need ``multiLine="true"``, which makes one task per file.
    The CSV parser drops NUL characters; all other text comes back as it was.
    """
    return _read(spark, path, "csv", schema, options)


def read_report(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A report, whether on one line or pretty-printed.

    The schema keeps both histograms maps; inference would make structs of them.
    """
    return _read(spark, path, "json", REPORT, {"multiLine": "true", "mode": "FAILFAST", **options})


def as_readings(df: DataFrame, customer_id: str, ts: str, power: str) -> DataFrame:
    """Gives a table's columns the names of the readings schema; the others stay."""
    return df.withColumnsRenamed({customer_id: "customer_id", ts: "ts", power: "power"})


def as_customers(
    df: DataFrame, customer_id: str, contract_type: str, usage_type: str
) -> DataFrame:
    """Gives a table's columns the names of the customer schema; the others stay."""
    return df.withColumnsRenamed(
        {
            customer_id: "customer_id",
            contract_type: "contract_type",
            usage_type: "usage_type",
        }
    )
