"""Reading the columnar tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table; zone-less timestamps become UTC instants so that
    watermarks and session functions accept them."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def spread(df: DataFrame) -> DataFrame:
    """Redistribute rows when a file has fewer splits than there are cores (one
    big row group); tables with enough splits are returned as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
