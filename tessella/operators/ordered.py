"""Ordered work inside keys that may be very hot.

A plain window over a key sorts all rows of that key in one task. Here every
key is cut into buckets of a coarse, monotone column (an hour, a block of
version numbers): the window only ever sees one bucket, and what a bucket needs
from earlier ones (row count, last row, running sum) comes from a table with
one row per bucket. The result equals the plain window, also for NULL keys and
NULL times, which form a key and a first bucket of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import cut


def _buckets(df: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """Adds `_g`, key and bucket as one value: never NULL itself, with equal NULLs inside.
    Windows and joins both go by it, so rows are shuffled and sorted once."""
    return df.withColumn("_g", F.struct(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], bucket.alias("_b")))


def _before(keys: list[str]):
    return (Window.partitionBy(*[f"_of._k{i}" for i in range(len(keys))]).orderBy("_of._b")
            .rowsBetween(Window.unboundedPreceding, -1))


def _with(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows beside the row of their bucket."""
    return rows.join(table, F.col("_g") == F.col("_of")).drop("_of")


def sequence_in_key(df: DataFrame, keys: list[str], bucket: Column, order: list[str],
                    name: str = "seq") -> DataFrame:
    """1, 2, 3 … per key in the given order."""
    rows = _buckets(df, keys, bucket)
    offsets = rows.groupBy(F.col("_g").alias("_of")).agg(F.count("*").alias("_n")).withColumn(
        "_off", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy("_g").orderBy(*order))
    return (_with(rows.withColumn("_r", local), offsets)
            .withColumn(name, (F.col("_r") + F.col("_off")).cast("long"))
            .drop("_g", "_r", "_off"))


def sequence_by_range(df: DataFrame, keys: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """The same without a bucket to go by: rows are dealt out by sampled splitters of keys
    and order together, so a key, or a key's part, that holds most rows is cut as finely
    as it needs; partitions are the buckets. order should tell the rows of a key apart."""
    dealt = cut(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in [*keys, *order]])
                .withColumn("_p", F.spark_partition_id()))  # kept, as splitters differ from run to run
    return sequence_in_key(dealt, keys, F.col("_p"), [F.col(c).asc_nulls_first() for c in order], name).drop("_p")


def running_sum_in_key(df: DataFrame, keys: list[str], bucket: Column, order: list[str],
                       value: Column, name: str) -> DataFrame:
    rows = _buckets(df, keys, bucket).withColumn("_v", value)
    offsets = rows.groupBy(F.col("_g").alias("_of")).agg(F.sum("_v").alias("_n")).withColumn(
        "_off", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0))).drop("_n")
    local = F.sum("_v").over(Window.partitionBy("_g").orderBy(*order)
                             .rowsBetween(Window.unboundedPreceding, 0))
    return (_with(rows.withColumn("_r", local), offsets)
            .withColumn(name, F.col("_r") + F.col("_off")).drop("_g", "_v", "_r", "_off"))


def previous_in_key(df: DataFrame, keys: list[str], bucket: Column, order: list[str],
                    columns: list[str], name: str = "prev") -> DataFrame:
    """Struct of the given columns of the row before, NULL for the first."""
    rows = _buckets(df, keys, bucket).withColumn("_s", F.struct(*columns))
    tails = rows.groupBy(F.col("_g").alias("_of")).agg(F.max_by("_s", F.struct(*order)).alias("_t")).withColumn(
        "_t", F.lag("_t").over(Window.partitionBy(*[f"_of._k{i}" for i in range(len(keys))]).orderBy("_of._b")))
    local = F.lag("_s").over(Window.partitionBy("_g").orderBy(*order))
    return (_with(rows.withColumn("_p", local), tails)
            .withColumn(name, F.coalesce("_p", "_t")).drop("_g", "_s", "_p", "_t"))
