"""Numbered snapshots of a table in a folder, committed by a manifest.

`save` writes the rows as Parquet into a folder of their own and then commits: a manifest
that names that folder is written beside and renamed to the next number. A rename to
a name that exists fails, so of two writers that reach for the same number one wins and
the other takes the next. Whoever reads goes by the manifests alone: rows of a writer
that failed half-way, or of a manifest that is not yet in place, are in no snapshot.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MANIFESTS = "_manifests"


class Folder:
    """The few file operations that commits need, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.path, self.jvm = path.rstrip("/"), jvm
        self.root = jvm.org.apache.hadoop.fs.Path(self.path)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self.root.getFileSystem(conf)
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(f.getPath().getName() for f in self.files.listStatus(at)) if self.files.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.files.open(self._at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Writes a file whole or not at all; False if there is one of this name."""
        held = self._at(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.files.create(held, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self.context.rename(held, self._at(name), none)  # without the option to overwrite
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            self.files.delete(held, False)
            return False


def _number(name: str) -> int | None:
    return int(name.removesuffix(".json")) if name.endswith(".json") and name.removesuffix(".json").isdigit() else None


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all committed snapshots, ascending."""
    return sorted(n for n in map(_number, Folder(spark, path).names(MANIFESTS)) if n is not None)


def commit(spark: SparkSession, path: str, data: str, about: dict) -> int:
    """Makes the folder `data` the next snapshot, whatever others commit meanwhile."""
    folder = Folder(spark, path)
    while True:
        n = (versions(spark, path) or [0])[-1] + 1
        if folder.write_new(f"{MANIFESTS}/{n:012d}.json", json.dumps({**about, "version": n, "data": data})):
            return n


def save(rows: DataFrame, path: str, **about: object) -> int:
    """Writes rows as a snapshot and returns its number."""
    data = f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{data}")
    return commit(rows.sparkSession, path, data, {"schema": rows.schema.jsonValue(), **about})


def describe(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(Folder(spark, path).read(f"{MANIFESTS}/{version:012d}.json"))


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A snapshot by its number, the latest one by default."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise ValueError(f"no snapshot {'' if version is None else version} in {path}")
    held = describe(spark, path, known[-1] if version is None else version)
    return spark.read.schema(StructType.fromJson(held["schema"])).parquet(f"{path}/{held['data']}")
