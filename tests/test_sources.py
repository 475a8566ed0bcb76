import pytest

from wattfold.operators import lp_summary
from wattfold.schemas import READINGS
from wattfold.sources import as_customers, as_readings, read_lp


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_input_formats(spark, hour_readings, tmp_path, fmt):
    path = str(tmp_path / "lp")
    lp = hour_readings.select("customer_id", "ts", "power")
    lp.write.format(fmt).option("header", "true").save(path)
    back = read_lp(spark, path, fmt)
    assert [f.dataType for f in back.schema] == [f.dataType for f in READINGS]
    assert sorted(back.collect()) == sorted(lp.collect())
    assert lp_summary(back).first() == lp_summary(lp).first()


def test_columns_keep_their_place(spark):
    df = spark.sql("SELECT 1 AS a, 2 AS meter, 3 AS kw, 4 AS at")
    assert as_readings(df, "meter", "at", "kw").columns == ["a", "customer_id", "power", "ts"]
    assert as_customers(df, "a", "kw", "at").columns == [
        "customer_id",
        "meter",
        "contract_type",
        "usage_type",
    ]
