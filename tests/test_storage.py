import pytest
from pyspark.errors import AnalysisException

from wattfold import scratch
from wattfold.operators import dataset_available, dataset_size_gib, dataset_state
from wattfold.plans import file_info
from wattfold.sinks import write_csv_bom, write_parquet


def test_size_counts_part_files_only(spark, hour_readings, tmp_path):
    path = tmp_path / "t.parquet"
    write_parquet(hour_readings.repartition(4), str(path))
    (path / "notes.txt").write_text("not data")
    sizes = [p.stat().st_size for p in path.glob("part-*")]
    row = dataset_size_gib(spark, str(path)).first()
    assert tuple(row) == (4, sum(sizes), sum(sizes) / 1024**3)


def test_size_of_a_partitioned_dataset(spark, hour_readings, tmp_path):
    path = tmp_path / "t"
    hour_readings.write.partitionBy("customer_id").parquet(str(path))
    sizes = [p.stat().st_size for p in path.glob("customer_id=*/part-*")]
    assert dataset_size_gib(spark, str(path)).first().n_bytes == sum(sizes)


def test_available(spark, hour_readings, tmp_path):
    path = tmp_path / "t.parquet"
    assert dataset_available(spark, str(path)) is False
    assert tuple(dataset_state(spark, str(path)).first()) == (False, None)
    path.mkdir()
    assert dataset_available(spark, str(path)) is False
    assert tuple(dataset_state(spark, str(path)).first()) == (False, 0.0)
    write_parquet(hour_readings.where("false"), str(path))
    assert dataset_available(spark, str(path)) is True
    assert dataset_state(spark, str(path)).first().available is True


def test_size_of_a_missing_dataset_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        dataset_size_gib(spark, str(tmp_path / "none"))


def test_file_info_without_parquet(spark, hour_readings, tmp_path):
    csv = str(tmp_path / "a.csv")
    write_csv_bom(hour_readings, csv)
    row = file_info(spark, csv, str(tmp_path / "b.parquet")).first()
    assert (row.parquet_file, row.parquet_size_gb, row.parquet_available) == (
        "b.parquet",
        None,
        False,
    )
    assert row.csv_file == "a.csv" and row.csv_size_gb > 0


def test_overwriting_replaces(spark, hour_readings, tmp_path):
    path = str(tmp_path / "t.parquet")
    for df in (hour_readings, hour_readings.limit(3)):
        write_parquet(df, path)
    assert spark.read.schema(hour_readings.schema).parquet(path).count() == 3


def test_scratch_lies_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    one, two = scratch.scratch_dir(spark), scratch.scratch_dir(spark)
    assert one.startswith(f"{shared}/wattfold-") and one != two


def test_scratch_without_a_shared_folder_lies_below_the_warehouse(spark, monkeypatch, tmp_path):
    own = {"spark.sql.warehouse.dir": str(tmp_path / "w")}
    monkeypatch.setattr(scratch, "_setting", lambda name, spark: own.get(name))
    assert scratch.scratch_dir(spark).startswith(f"{tmp_path}/w/wattfold-")
    assert (tmp_path / "w").exists()
