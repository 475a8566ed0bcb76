from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattfold.functions import bytes_to_gib


def _part_files(spark: SparkSession, path: str) -> DataFrame:
    # Only the length column is asked for, so no file is opened.
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "part-*")
        .load(path)
        .select("length")
    )


def dataset_size_gib(spark: SparkSession, path: str) -> DataFrame:
    """One row: number of part files, their bytes, and the bytes in GiB."""
    return (
        _part_files(spark, path)
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("n_bytes"),
        )
        .select("n_files", "n_bytes", bytes_to_gib(F.col("n_bytes")).alias("size_gib"))
    )


def dataset_state(spark: SparkSession, path: str) -> DataFrame:
    """One row: whether the dataset is available, and its size, null where nothing is.

    One listing answers both, and no job runs before the row is asked for.
    """
    try:
        sizes = dataset_size_gib(spark, path)
    except AnalysisException as e:
        if not _is_missing(e):
            raise
        return spark.sql("SELECT false AS available, CAST(NULL AS DOUBLE) AS size_gib")
    return sizes.select((F.col("n_files") > 0).alias("available"), "size_gib")


def dataset_available(spark: SparkSession, path: str) -> bool:
    """Whether the dataset exists and holds at least one part file."""
    return dataset_state(spark, path).first()["available"]


def _is_missing(e: AnalysisException) -> bool:
    return e.getCondition() == "PATH_NOT_FOUND"
