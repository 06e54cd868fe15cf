"""Intermediate tables, and column names that are free."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidelog.stage import Tables, table

__all__ = ["Tables", "long_rows", "table", "unused"]

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def long_rows(df: DataFrame) -> DataFrame:
    """The table, its session set to hand texts to Python 1000 rows at a time where the setting is Spark's own 10,000."""
    if df.sparkSession.conf.get(_ROWS) == "10000":
        df.sparkSession.conf.set(_ROWS, "1000")
    return df


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as no column of the table has (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
