"""Where scratch lies, and when it goes."""

import os

import pytest

from wattfold import scratch
from wattfold.scratch import own_scratch, scratch_dir


def test_own_scratch_goes_at_the_end(spark):
    kept = scratch_dir(spark)
    spark.range(3).write.parquet(kept)
    with own_scratch(spark):
        gone = scratch_dir(spark)
        spark.range(4).write.parquet(gone)
        with own_scratch(spark):
            inner = scratch_dir(spark)
            spark.range(5).write.parquet(inner)
        assert not os.path.exists(inner) and spark.read.parquet(gone).count() == 4
    assert not os.path.exists(gone)
    assert spark.read.parquet(kept).count() == 3


def test_own_scratch_goes_after_a_failure(spark):
    with pytest.raises(ZeroDivisionError), own_scratch(spark):
        gone = scratch_dir(spark)
        spark.range(4).write.parquet(gone)
        raise ZeroDivisionError
    assert not os.path.exists(gone)
    assert os.path.dirname(scratch_dir(spark)) == os.path.dirname(os.path.dirname(gone))


class Elsewhere:
    """A session on a cluster whose warehouse is a folder of the machine."""

    def __init__(self, spark, **conf):
        self.own, self.settings = spark, conf
        self._jvm, self._jsc = spark._jvm, spark._jsc

    @property
    def conf(self):
        return self

    def get(self, name, default):
        return self.settings.get(name, default)

    @property
    def sparkContext(self):
        return self

    master = "spark://somewhere:7077"
    applicationId = "app-1"


def test_local_folders_are_refused_on_a_cluster(spark, tmp_path):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Elsewhere(spark, **{"spark.sql.warehouse.dir": f"file:{tmp_path}"}))
    # A folder that the cluster names is shared, whatever its scheme.
    named = Elsewhere(spark, **{"spark.checkpoint.dir": f"file:{tmp_path}", "spark.sql.warehouse.dir": "x"})
    assert scratch_dir(named).startswith(f"file:{tmp_path}/wattfold-app-1/")
    assert scratch._below.get() == ""
