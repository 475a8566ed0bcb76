"""The batch job: two stored tables in, two datasets and a report out.

    spark-submit --py-files wattfold.zip wattfold/job.py \\
        --customers <path> --lp <path> [<path> ...] --out <folder>
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import SparkSession

from wattfold.plans import build_report
from wattfold.schemas import CUSTOMERS, READINGS
from wattfold.sinks import remove, write_report
from wattfold.sources import read_customers, read_lp


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="wattfold", description=__doc__.splitlines()[0])
    parser.add_argument("--customers", required=True, help="the customer master")
    parser.add_argument("--lp", required=True, nargs="+", help="the readings")
    parser.add_argument("--out", required=True, help="folder for all outputs")
    parser.add_argument("--format", default="parquet", help="input format of both tables")
    parser.add_argument("--customers-schema", help="DDL, where columns are added")
    parser.add_argument("--lp-schema", help="DDL, where columns are added")
    args = parser.parse_args(argv)

    # One clock reading for the whole run.
    run_ts = datetime.now()
    spark = SparkSession.builder.appName("wattfold").getOrCreate()
    customers = read_customers(
        spark, args.customers, args.format, args.customers_schema or CUSTOMERS
    )
    lp = read_lp(spark, args.lp, args.format, args.lp_schema or READINGS)
    # An earlier run's report must not stand beside what a failed one leaves.
    remove(spark, f"{args.out}/report.json")
    report = build_report(customers, lp, args.out, run_ts)
    write_report(report, f"{args.out}/report.json")


if __name__ == "__main__":
    main()
