from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

BYTE_ORDER_MARK = "\ufeff"

# Spark's defaults would cut fractions to milliseconds, trim blanks off values and
# write a quote inside a value as \" instead of "". Zone-less timestamps are cast to
# text, which has as many fraction digits as the value needs and mostly none.
CSV_WRITE_OPTIONS = {
    "header": "true",
    "encoding": "UTF-8",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX",
}


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", **options: str) -> None:
    df.write.mode(mode).options(**options).parquet(path)


def write_csv_bom(df: DataFrame, path: str, mode: str = "overwrite", **options: str) -> None:
    """CSV in UTF-8 in which every part file starts with a byte-order mark.

    Spark has no charset for that, so the mark goes in front of the first header name.
    """
    first, *rest = df.columns
    if set(first) & set(',"\r\n'):
        raise ValueError(f"header name would be quoted, in front of its mark: {first!r}")
    marked = _plain_timestamps(df).toDF(BYTE_ORDER_MARK + first, *rest)
    marked.write.mode(mode).options(**{**CSV_WRITE_OPTIONS, **options}).csv(path)


def _plain_timestamps(df: DataFrame) -> DataFrame:
    columns = {f.name: F.col(_quoted(f.name)) for f in df.schema}
    texts = {
        f.name: columns[f.name].cast("string")
        for f in df.schema
        if isinstance(f.dataType, TimestampNTZType)
    }
    return df.select(*(c.alias(name) for name, c in {**columns, **texts}.items()))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The one-row report as JSON, non-ASCII text as it is, null fields included."""
    report.coalesce(1).write.mode(mode).option("ignoreNullFields", "false").json(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a dataset, in whichever store its path names, if there is one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
