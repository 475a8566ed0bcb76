"""Made-up inputs whose counts and mean are the published ones."""

from pyspark.sql import functions as F

# The published histograms, largest first.
CONTRACT_TYPES = {
    "226 일반용(을) 고압A": 50,
    "322 산업용(갑)‖고압A": 41,
    "311 산업용(갑) 저압": 39,
    "222 일반용(갑)‖고압A": 37,
    "726 산업용(을) 고압A": 33,
}
USAGE_TYPES = {"02 상업용": 105, "09 광공업용": 95}

# The published totals, range and mean.
CUSTOMERS = 200
READINGS = 57_600
METERED_CUSTOMERS = 10
START, END = "2024-03-01 00:00:00", "2024-03-30 23:45:00"
AVG_POWER = 53.65882291666668


def _label(counts):
    """The label of a row number, the labels following each other in order."""
    label, upper = None, 0
    for name, n in counts.items():
        upper += n
        below = F.col("id") < upper
        label = F.when(below, name) if label is None else label.when(below, name)
    return label


def golden_customers(spark):
    return spark.range(CUSTOMERS).select(
        F.format_string("C%03d", "id").alias("customer_id"),
        _label(CONTRACT_TYPES).alias("contract_type"),
        _label(USAGE_TYPES).alias("usage_type"),
    )


def golden_readings(spark):
    return spark.range(READINGS).selectExpr(
        "format_string('C%03d', id div 5760) AS customer_id",
        "timestamp_ntz'2024-03-01 00:00:00'"
        " + make_dt_interval(0, 0, int(15 * ((id % 5760) div 2)), 0) AS ts",
        "CASE WHEN id < 33882 THEN 53.7D ELSE 53.6D END AS power",
    )
