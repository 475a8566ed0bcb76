"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattfold.scratch import scratch_dir


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the session's shared folder and read again.

    It cuts the lineage: a lost executor costs the tasks it ran, not the stages before.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone; a null text becomes the empty one."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def slabs(
    batches: Iterator[pa.RecordBatch], max_rows: int = 4096, max_bytes: int = 16 << 20
) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts in slabs of bounded rows and bytes; a longer text is a slab alone.

    The slab is the unit of memory in a Python worker, whatever Arrow's batches are.
    """
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        sizes = pa.compute.binary_length(texts).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and (held + size > max_bytes or i - start >= max_rows):
                yield ids.slice(start, i - start), texts.slice(start, i - start).to_pylist()
                start, held = i, 0
            held += size
        if sizes:
            yield ids.slice(start), texts.slice(start).to_pylist()
