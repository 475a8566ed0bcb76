"""Schemas of the two inputs and of the report. Every read names one; none is inferred."""

from pyspark.sql import types as T

CUSTOMERS = T.StructType(
    [
        T.StructField("customer_id", T.StringType(), False),
        T.StructField("contract_type", T.StringType(), False),
        T.StructField("usage_type", T.StringType(), False),
    ]
)

READINGS = T.StructType(
    [
        T.StructField("customer_id", T.StringType(), False),
        T.StructField("ts", T.TimestampNTZType(), False),
        T.StructField("power", T.DoubleType()),
    ]
)

_COUNTS = T.MapType(T.StringType(), T.LongType())

_DATE_RANGE = T.StructType(
    [T.StructField("start", T.StringType()), T.StructField("end", T.StringType())]
)

CUSTOMER_SECTION = T.StructType(
    [
        T.StructField("total_customers", T.LongType()),
        T.StructField("contract_types", _COUNTS),
        T.StructField("usage_types", _COUNTS),
    ]
)

LP_SECTION = T.StructType(
    [
        T.StructField("total_records", T.LongType()),
        T.StructField("total_customers", T.LongType()),
        T.StructField("date_range", _DATE_RANGE),
        T.StructField("avg_power", T.DoubleType()),
    ]
)

FILE_INFO = T.StructType(
    [
        T.StructField("csv_file", T.StringType()),
        T.StructField("csv_size_gb", T.DoubleType()),
        T.StructField("parquet_file", T.StringType()),
        T.StructField("parquet_size_gb", T.DoubleType()),
        T.StructField("parquet_available", T.BooleanType()),
        T.StructField("encoding", T.StringType()),
    ]
)

PROCESSED_SECTION = T.StructType(
    [
        T.StructField("total_records", T.LongType()),
        T.StructField("total_customers", T.LongType()),
        T.StructField("date_range", _DATE_RANGE),
        T.StructField("file_info", FILE_INFO),
        T.StructField("processed_timestamp", T.StringType()),
    ]
)

METADATA_SECTION = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("analysis_stage", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("total_customers", T.LongType()),
        T.StructField("total_lp_records", T.LongType()),
    ]
)

REPORT = T.StructType(
    [
        T.StructField("customer_summary", CUSTOMER_SECTION),
        T.StructField("lp_data_summary", LP_SECTION),
        T.StructField("processed_lp_data", PROCESSED_SECTION),
        T.StructField("metadata", METADATA_SECTION),
    ]
)
