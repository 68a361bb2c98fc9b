"""Report sinks: CSV and JSON rows of any result, written in parallel or returned as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_line(columns: list[str]) -> Column:
    """The columns as one CSV line."""
    return F.to_csv(F.struct(*columns))


def json_line(columns: list[str]) -> Column:
    """The columns as one JSON object; nulls are kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").mode("overwrite").json(path)
