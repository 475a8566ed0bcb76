from datetime import datetime

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tests.golden import golden_customers, golden_readings

# Fixed value: the published stamp.
RUN_TS = datetime(2025, 7, 9, 23, 9, 19, 679137)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def customers(spark):
    return golden_customers(spark)


@pytest.fixture(scope="session")
def readings(spark):
    return golden_readings(spark)


@pytest.fixture(scope="session")
def golden_run(spark, customers, readings, tmp_path_factory):
    """One run of the whole job: the folder, and the report as it reads back."""
    from wattfold.plans import build_report
    from wattfold.sinks import write_report
    from wattfold.sources import read_report

    out = tmp_path_factory.mktemp("golden")
    report = build_report(customers, readings, str(out), RUN_TS)
    write_report(report, str(out / "report.json"))
    return out, read_report(spark, str(out / "report.json")).first()


@pytest.fixture
def hour_readings(spark):
    """Three customers with one reading per hour and a note column."""
    return spark.range(30).select(
        F.format_string("%02d", F.col("id") % 3).alias("customer_id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, int(id), 0, 0)").alias(
            "ts"
        ),
        (F.col("id") / 4).alias("power"),
        F.lit("a, b").alias("note"),
    )
