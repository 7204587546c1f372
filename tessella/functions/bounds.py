"""Broadcasting only what is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bounded_broadcast(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Hint a broadcast once a capped count proves the side small; otherwise
    leave it to a shuffle join, which AQE splits where keys are skewed."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table written in code, hence bounded by it."""
    return spark.createDataFrame(rows, schema)


def fixed_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(literal_table(spark, rows, schema))
