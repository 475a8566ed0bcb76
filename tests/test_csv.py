import random
from datetime import datetime, timedelta

import pytest

from wattfold.schemas import CUSTOMERS
from wattfold.sinks import write_csv_bom
from wattfold.sources import read_csv, read_customers, read_lp

SCHEMA = "customer_id string, ts timestamp_ntz, power double, note string"
NOON = datetime(2024, 1, 1, 12)

ONE_LINE_ROWS = [
    ("a", datetime(2024, 3, 10, 2, 30, 0, 1), 1.5, " lead"),
    ("b", datetime(2024, 3, 10, 2, 30), None, ""),
    ("c", datetime(1999, 12, 31, 23, 59, 59, 999999), 0.1, None),
    ('d"q,', NOON, float("inf"), "back\\slash"),
    ("e", NOON, 1e22, '\\"'),
    ("f", NOON, 1e-7, "trail "),
    ("02 상업용‖", NOON, 1 / 3, '"'),
    ("#g", NOON, -0.5, "\t"),
    ("", NOON, 1.0, "null"),
    (None, NOON, 2.0, 'x"y"'),
]
ODD_CHARACTERS = "aN0#-'\",\\ \t\x01\x1f\x85\xa0\u2028\ufeff‖상é😀"
ROWS_WITH_BREAKS = [("h", NOON, 1.0, "line\nbreak"), ("i", NOON, 1.0, "cr\rx\r\ny")]


def by_text(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize(
    "rows, multi_line",
    [(ONE_LINE_ROWS, "false"), (ONE_LINE_ROWS + ROWS_WITH_BREAKS, "true")],
)
def test_nothing_changes_on_the_way(spark, tmp_path, rows, multi_line):
    path = str(tmp_path / "t.csv")
    write_csv_bom(spark.createDataFrame(rows, SCHEMA), path)
    back = read_csv(spark, path, SCHEMA, multiLine=multi_line)
    assert by_text(back.collect()) == by_text(rows)


def test_random_texts(spark, tmp_path):
    draw = random.Random(7)

    def text():
        n = draw.randrange(-1, 5)
        return None if n < 0 else "".join(draw.choices(ODD_CHARACTERS, k=n))

    def row():
        ts = datetime(1900, 1, 1) + timedelta(microseconds=draw.randrange(10**16))
        power = draw.choice([None, draw.random() * 10.0 ** draw.randrange(-300, 300)])
        return text(), ts, power, text()

    rows = [row() for _ in range(5000)]
    path = str(tmp_path / "t.csv")
    write_csv_bom(spark.createDataFrame(rows, SCHEMA), path)
    assert by_text(read_csv(spark, path, SCHEMA).collect()) == by_text(rows)


def test_every_part_has_its_mark_and_header(spark, hour_readings, tmp_path):
    path = tmp_path / "t.csv"
    write_csv_bom(hour_readings.repartition(3), str(path))
    parts = list(path.glob("part-*"))
    assert len(parts) == 3
    for part in parts:
        text = part.read_bytes()
        assert text.startswith(b"\xef\xbb\xbfcustomer_id,ts,power,note\n")
        assert text.count(b"\xef\xbb\xbf") == 1
        assert text.decode("utf-8-sig").startswith("customer_id,")


def test_timestamps_have_the_digits_they_need(spark, tmp_path):
    df = spark.sql(
        "SELECT timestamp_ntz'2024-03-01 00:15:00' AS `t.a`,"
        " timestamp_ntz'2024-03-10 02:30:00.000500' AS `b``c`"
    )
    write_csv_bom(df, str(tmp_path / "t.csv"))
    (part,) = (tmp_path / "t.csv").glob("part-*")
    assert part.read_text("utf-8-sig") == (
        "t.a,b`c\n2024-03-01 00:15:00,2024-03-10 02:30:00.0005\n"
    )
    assert read_csv(spark, str(tmp_path / "t.csv"), df.schema).first() == df.first()


def test_line_breaks_need_multi_line(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    write_csv_bom(spark.createDataFrame(ROWS_WITH_BREAKS, SCHEMA), path)
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        read_csv(spark, path, SCHEMA).collect()


def test_no_rows_still_make_a_header(spark, hour_readings, tmp_path):
    path = tmp_path / "t.csv"
    write_csv_bom(hour_readings.where("false"), str(path))
    (part,) = path.glob("part-*")
    assert part.read_bytes() == b"\xef\xbb\xbfcustomer_id,ts,power,note\n"
    assert read_csv(spark, str(path), hour_readings.schema).count() == 0


def test_header_that_would_be_quoted(spark, tmp_path):
    with pytest.raises(ValueError, match="quoted"):
        write_csv_bom(spark.range(1).toDF("a,b"), str(tmp_path / "t.csv"))


def test_leading_zeros_stay(spark, tmp_path):
    path = tmp_path / "customers.csv"
    path.write_text("customer_id,contract_type,usage_type\n007,0226,02\n", "utf-8")
    assert tuple(read_customers(spark, str(path), "csv").first()) == ("007", "0226", "02")


def test_columns_in_another_order_stop_the_read(spark, tmp_path):
    path = tmp_path / "customers.csv"
    path.write_text("customer_id,usage_type,contract_type\n1,02,226\n", "utf-8")
    with pytest.raises(Exception, match="CSV header does not conform"):
        read_customers(spark, str(path), "csv", CUSTOMERS).collect()


def test_malformed_reading_stops_the_read(spark, tmp_path):
    path = tmp_path / "lp.csv"
    path.write_text("customer_id,ts,power\n1,2024-03-01 00:15:00,abc\n", "utf-8")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        read_lp(spark, str(path), "csv").collect()


def test_readings_in_several_files_and_own_pattern(spark, tmp_path):
    paths = []
    for day in (1, 2):
        path = tmp_path / f"{day}.csv"
        path.write_text(f"customer_id,ts,power\n1,0{day}.03.2024 00:15,1.5\n", "utf-8")
        paths.append(str(path))
    df = read_lp(spark, paths, "csv", timestampNTZFormat="dd.MM.yyyy HH:mm")
    assert sorted(r.ts for r in df.collect()) == [
        datetime(2024, 3, 1, 0, 15),
        datetime(2024, 3, 2, 0, 15),
    ]
