from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

_below: ContextVar[str] = ContextVar("below", default="")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name for tables that one query writes and another stage reads.

    It lies in the shared folder the cluster names in ``spark.checkpoint.dir``; where that
    is unset, below the session's warehouse, if executors share that. All of an
    application's scratch lies in one folder, which the driver's JVM deletes as it ends,
    because the tables are read lazily and only ``own_scratch`` knows when they are done
    with.
    """
    return f"{_top(spark)}/{_below.get()}{uuid.uuid4().hex}"


@contextmanager
def own_scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch that is made within is deleted at the end, when nothing may read it any more."""
    name = f"{_below.get()}{uuid.uuid4().hex}/"
    before = _below.set(name)
    try:
        yield
    finally:
        _below.reset(before)
        path = _path(spark, f"{_top(spark)}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _top(spark: SparkSession) -> str:
    shared = _setting("spark.checkpoint.dir", spark)
    if not shared:
        shared = _setting("spark.sql.warehouse.dir", spark)
        local = _path(spark, shared).toUri().getScheme() in (None, "file")
        if local and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"executors don't share {shared}: set spark.checkpoint.dir")
    top = f"{shared.rstrip('/')}/wattfold-{spark.sparkContext.applicationId}"
    path = _path(spark, top)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.mkdirs(path):
        fs.deleteOnExit(path)
    return top


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _setting(name: str, spark: SparkSession) -> str | None:
    return spark.conf.get(name, None)
