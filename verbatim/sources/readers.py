"""Readers for response tables.

Every reader is lazy and takes the columns it should return, so that the scan
reads only those columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """Read a table file; ``columns`` prunes the scan, None reads all."""
    df = spark.read.format(fmt).load(path)
    return df.select(*columns) if columns else df


def scan_table(spark: SparkSession, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Read a catalog table."""
    df = spark.table(name)
    return df.select(*columns) if columns else df


def scan_except_cast(df: DataFrame, column: str, to: str = "string") -> DataFrame:
    """All columns, with one of them moved to the end and cast."""
    return df.selectExpr(f"* except(`{column}`)", f"cast(`{column}` as {to}) as `{column}`")


def scan_csv(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = False) -> DataFrame:
    """Read CSV files with a header.

    Fields with line breaks need ``multi_line``, which makes each file one task.
    """
    return (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .schema(schema)
        .csv(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Write CSV files that ``scan_csv`` reads back unchanged."""
    (
        df.write.option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .mode("errorifexists")
        .csv(path)
    )


def date_from_millis(ms: Column | str) -> Column:
    """Calendar date of an epoch-millisecond value (session time zone)."""
    return F.to_date(F.timestamp_millis(F.col(ms) if isinstance(ms, str) else ms))
