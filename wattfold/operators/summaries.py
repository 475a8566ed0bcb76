from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattfold.functions import ordered_count_map, seconds_text
from wattfold.operators.combine import side_by_side


def distinct_count(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row: the exact number of distinct values of a column, nulls left out.

    Each task drops its repeats before the shuffle, so a value that fills a third of
    the table still costs one shuffled row per task.
    """
    return df.select(column).distinct().agg(F.count(column).alias(name))


def label_counts(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rows per label, in no order. Each task counts before the shuffle."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def category_counts(df: DataFrame, column: str, name: str = "n_customers") -> DataFrame:
    """Rows per label, largest first, ties by label."""
    return label_counts(df, column, name).orderBy(F.desc(name), F.asc(column))


def category_map(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row: the same counts as an ordered map, in which labels of one text are one.

    A map's keys are texts, so a missing label and the text ``null`` share an entry, as do
    labels that differ in nothing their text shows; ``category_counts`` keeps them apart.
    The entries add up to the rows either way. The map is one row, so all labels are
    gathered in one task, after counting.
    """
    n = f"n_{column}"
    key = F.coalesce(F.col(column).cast("string"), F.lit("null"))
    counts = df.groupBy(key.alias("key")).agg(
        F.count(F.lit(1)).alias(n), F.min(column).alias("label")
    )
    entries = ordered_count_map(F.col("key"), F.col(n), F.col("label"))
    return counts.agg(entries.alias(name))


def customer_total(df: DataFrame) -> DataFrame:
    """One row: rows of the customer master and distinct customers in it."""
    return side_by_side(
        df.agg(F.count(F.lit(1)).alias("total_customers")),
        distinct_count(df, "customer_id", "distinct_customers"),
    )


def lp_total(df: DataFrame) -> DataFrame:
    """One row: readings and distinct customers."""
    return side_by_side(df.agg(*_totals()), _customers(df))


def lp_range(df: DataFrame) -> DataFrame:
    """One row: first and last timestamp, as text."""
    return df.agg(*_range())


def lp_average(df: DataFrame) -> DataFrame:
    """One row: mean power over all readings that have one."""
    return df.agg(*_average())


def lp_summary(df: DataFrame, with_average: bool = True, one_scan: bool = False) -> DataFrame:
    """One row: readings, distinct customers, first and last timestamp, mean power.

    Counts, range and mean need no shuffle but one row per task; only the distinct
    count moves data. Kept apart, they scan disjoint columns and the shuffle carries
    bare customer ids. ``one_scan`` is for row formats such as CSV, where a second
    scan would parse all the text again.
    """
    measures = [*_totals(), *_range(), *(_average() if with_average else [])]
    names = ["total_records", "total_customers", "start_ts", "end_ts"]
    names += ["avg_power"] if with_average else []
    if one_scan:
        distinct = F.count_distinct("customer_id").alias("total_customers")
        return df.agg(*measures, distinct).select(*names)
    return side_by_side(df.agg(*measures), _customers(df)).select(*names)


def lp_measures() -> list[Column]:
    """All measures of the summary but the distinct count, as plain aggregates."""
    power = [F.sum("power").alias("sum_power"), F.count("power").alias("n_power")]
    return [*_totals(), *_range(), *power]


def lp_summary_of(lp: DataFrame, measures: dict) -> DataFrame:
    """The summary from measures that were taken while the readings were written.

    Only the distinct count reads the source again, and it shuffles bare ids.
    """
    total = F.lit(measures.get("sum_power")).cast("double")
    mean = F.try_divide(total, F.lit(measures.get("n_power")))
    taken = lp.sparkSession.range(1).select(
        F.lit(measures.get("total_records", 0)).cast("bigint").alias("total_records"),
        *(F.lit(measures.get(c)).cast("string").alias(c) for c in ("start_ts", "end_ts")),
        mean.cast("double").alias("avg_power"),
    )
    names = ["total_records", "total_customers", "start_ts", "end_ts", "avg_power"]
    return side_by_side(taken, _customers(lp)).select(*names)


def _totals() -> list[Column]:
    return [F.count(F.lit(1)).alias("total_records")]


def _range() -> list[Column]:
    return [
        seconds_text(F.min("ts")).alias("start_ts"),
        seconds_text(F.max("ts")).alias("end_ts"),
    ]


def _average() -> list[Column]:
    # For a decimal power, avg() would round to a few digits; the sum is exact.
    total = F.sum("power").cast("double")
    return [F.try_divide(total, F.count("power")).alias("avg_power")]


def _customers(df: DataFrame) -> DataFrame:
    return distinct_count(df, "customer_id", "total_customers")
