import pytest
from pyspark.sql import functions as F

from wattfold.operators import (
    category_counts,
    category_map,
    customer_total,
    distinct_count,
    lp_average,
    lp_range,
    lp_summary,
    lp_total,
    side_by_side,
)
from wattfold.plans import report_long


def labels(spark, values):
    return spark.createDataFrame([(v,) for v in values], "k string")


def test_ties_are_ordered_by_label(spark):
    counts = category_counts(labels(spark, "cbacbad"), "k", "n").collect()
    assert [tuple(r) for r in counts] == [("a", 2), ("b", 2), ("c", 2), ("d", 1)]


def test_ties_of_numbers_are_ordered_as_numbers(spark):
    df = spark.createDataFrame([(10,), (9,), (10,), (9,)], "k int")
    keys = category_map(df, "k", "m").select(F.map_keys("m")).first()[0]
    assert keys == ["9", "10"]


def test_missing_label(spark):
    df = labels(spark, ["a", None, None])
    assert [tuple(r) for r in category_counts(df, "k", "n").collect()] == [(None, 2), ("a", 1)]
    assert category_map(df, "k", "m").first().m == {"null": 2, "a": 1}


def test_a_label_column_called_n(spark):
    assert category_map(labels(spark, "aab").toDF("n"), "n", "n").first().n == {"a": 2, "b": 1}


def test_no_customers_give_an_empty_map(spark):
    assert category_map(labels(spark, []), "k", "m").first().m == {}


def test_a_map_of_very_many_labels(spark):
    df = spark.range(100_500).selectExpr("string(id) AS k").union(labels(spark, ["7"]))
    m = F.col("m")
    row = category_map(df, "k", "m").select(F.size(m), F.map_keys(m)[0], m["7"]).first()
    assert tuple(row) == (100_500, "7", 2)


def test_labels_of_one_text_are_one_entry(spark):
    df = labels(spark, ["a", None, "null", "null"])
    assert category_map(df, "k", "m").first().m == {"null": 3, "a": 1}
    assert category_counts(df, "k", "n").count() == 3


def test_parts_with_a_name_in_common_are_refused(spark):
    one, two = (spark.range(1).select(F.lit(i).alias("n")) for i in (1, 2))
    with pytest.raises(ValueError, match="n"):
        side_by_side(one, two)


def test_repeated_and_missing_customers(spark):
    df = spark.createDataFrame([("1",), ("1",), ("2",), (None,)], "customer_id string")
    assert tuple(customer_total(df).first()) == (4, 2)
    assert distinct_count(df, "customer_id", "n").first().n == 2


@pytest.mark.parametrize("one_scan", [False, True])
def test_no_readings(readings, one_scan):
    empty = readings.where("false")
    assert tuple(lp_summary(empty, one_scan=one_scan).first()) == (0, 0, None, None, None)


@pytest.mark.parametrize("one_scan", [False, True])
def test_missing_power_is_left_out_of_the_mean(spark, one_scan):
    df = spark.sql(
        "SELECT * FROM VALUES ('a', timestamp_ntz'2024-01-01', 1.0D),"
        " ('b', timestamp_ntz'2024-01-02 03:04:05.999999', NULL),"
        " ('b', timestamp_ntz'2024-01-02', 2.0D) AS t(customer_id, ts, power)"
    )
    want = (3, 2, "2024-01-01 00:00:00", "2024-01-02 03:04:05", 1.5)
    assert tuple(lp_summary(df, one_scan=one_scan).first()) == want
    assert tuple(lp_total(df).first()) == want[:2]
    assert tuple(lp_range(df).first()) == want[2:4]
    assert tuple(lp_average(df).first()) == want[4:]


@pytest.mark.parametrize("one_scan", [False, True])
def test_decimal_power_gives_an_exact_mean(readings, one_scan):
    df = readings.withColumn("power", F.col("power").cast("decimal(10,1)"))
    for n in (1, 3, 8):
        mean = lp_summary(df.repartition(n), one_scan=one_scan).first().avg_power
        assert mean == 3090748.2 / 57_600


def test_one_customer_with_most_readings(spark):
    df = spark.range(90_000).selectExpr(
        "IF(id % 3 > 0, 'hot', string(id)) AS customer_id",
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, int(id), 0) AS ts",
        "double(id % 7) AS power",
    )
    row = lp_summary(df.repartition(8)).first()
    assert (row.total_records, row.total_customers) == (90_000, 30_001)


def test_long_report_holds_any_number_of_labels(spark, readings):
    master = spark.range(50).selectExpr(
        "string(id) AS customer_id", "string(id) AS contract_type", "'x' AS usage_type"
    )
    rows = {(r.section, r.key): r.value for r in report_long(master, readings, readings).collect()}
    assert sum(section == "contract_types" for section, _ in rows) == 50
    assert rows["usage_types", "x"] == "50"
    assert rows["metadata", "total_lp_records"] == "57600"
    assert rows["processed_lp_data", "date_range.end"] == "2024-03-30 23:45:00"
