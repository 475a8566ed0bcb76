"""Operators: DataFrame in, DataFrame out, nothing collected."""

from wattfold.operators.combine import side_by_side
from wattfold.operators.storage import dataset_available, dataset_size_gib, dataset_state
from wattfold.operators.summaries import (
    category_counts,
    category_map,
    customer_total,
    distinct_count,
    label_counts,
    lp_average,
    lp_measures,
    lp_range,
    lp_summary,
    lp_summary_of,
    lp_total,
)

__all__ = [
    "category_counts",
    "category_map",
    "customer_total",
    "dataset_available",
    "dataset_size_gib",
    "dataset_state",
    "distinct_count",
    "label_counts",
    "lp_average",
    "lp_measures",
    "lp_range",
    "lp_summary",
    "lp_summary_of",
    "lp_total",
    "side_by_side",
]
