"""Evaluating computed values once: as a variable, or unnested into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keys: list[str], items: Column, name: str) -> DataFrame:
    """One row per array element. For a plain explode the optimizer infers
    filters on the array's size and nullness, and for an array that is computed
    rather than stored these compute it again; the outer form is free of that."""
    return df.select(*keys, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def bind(value: Column, use) -> Column:
    """Evaluate an expression once and use it as a variable, also in lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that comes out of a generator, so that what is built on it reads the
    value: it is not computed again per use, and Python functions may follow each other
    with expressions in between."""
    one = F.explode_outer(F.array(F.struct(value.alias(name)))).alias("_one")  # outer: no filter is inferred that computes it twice
    return df.select("*", one).select(*[F.col(c) for c in df.columns if c != name], F.col("_one").getField(name).alias(name))
