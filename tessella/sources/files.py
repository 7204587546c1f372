"""Reading folders of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import files as fx
from tessella.sources.corpus import CorpusSource


def corpus(spark: SparkSession, **options: str) -> DataFrame:
    """Rows of the corpus source (see corpus)."""
    spark.dataSource.register(CorpusSource)
    return spark.read.format("corpus").options(**options).load()


def corpus_scan(spark: SparkSession, folder: str, extension: str = "txt") -> DataFrame:
    """(path, name, content) of every matching file below a folder; content is NULL where a
    file cannot be read or is neither UTF-8 nor GBK."""
    return corpus(spark, path=folder, extension=extension).select("path", "name", "content")


def write_files(rows: DataFrame, folder: str) -> None:
    """A file for each row (name, content, encoding); content is text or bytes."""
    rows.sparkSession.dataSource.register(CorpusSource)
    rows.write.format("corpus").mode("append").save(folder)


def decode_with_fallback(content: Column) -> Column:
    """UTF-8, else GBK (needs spark.sql.legacy.javaCharsets=true)."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "GBK"))


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Inventory rows of a folder; file contents are not read."""
    path = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/*(?=/)", "")
    rows = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
            .select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_time")))
    name = fx.base_name(F.col("path"))
    depth = F.size(F.split("path", "/")) - F.size(F.split(F.lit(folder.rstrip("/")), "/"))
    return rows.select("path", name.alias("name"), fx.extension(name).alias("extension"), "size", "modified_time",
                       F.col("modified_time").alias("created_time"), fx.dir_name(F.col("path")).alias("parent"),
                       depth.alias("depth"))
