from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(*one_rows: DataFrame) -> DataFrame:
    """One row with the columns of several one-row results; a repeated name is refused.

    A union in which each column has one row that may hold a value. Spark runs the
    parts side by side in one job, without a join. Scalar subqueries would do the same,
    but where they nest, outer ones hold threads of the pool that the inner ones wait
    for, and a few such queries at a time stop a session for good.
    """
    names = [c.lower() for part in one_rows for c in part.columns]
    if repeated := sorted({c for c in names if names.count(c) > 1}):
        raise ValueError(f"columns in more than one part: {repeated}")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_rows)
    return rows.agg(*(F.any_value(c, F.lit(True)).alias(c) for c in rows.columns))
