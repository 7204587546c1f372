"""A data source of text files: `spark.read.format("corpus")`, `df.write.format("corpus")`.

Reading lists the files below a folder, or takes a list of paths, and packs them into
partitions of a bounded size, largest first, so that many small files make few tasks and a
large one is a task of its own. A file is read as UTF-8, else as GBK; what is neither, or
cannot be read, or is not there although it is named, is a row with NULL content and the
reason in `error`. Conditions on name, path or extension leave out files before
anything is opened (spark.sql.python.filterPushdown.enabled). Writing makes a file per row
(name, content, encoding) beside its final place and moves all of them in when every
task is done, so a failed or repeated task leaves nothing behind.

Files are opened by pyarrow, which knows local folders, HDFS, S3 and others by their URI.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition,
                                    StringEndsWith, StringStartsWith, WriterCommitMessage)
from pyspark.sql.types import StructType

PARTITION_BYTES = 64 << 20
PARTITION_FILES = 5000
SCHEMA = "path string, name string, extension string, size long, encoding string, content string, error string"
ENCODINGS = ("utf-8", "gbk")


@dataclass
class Files(InputPartition):
    """Paths of a partition with their sizes, -1 where there is no file."""

    paths: list[tuple[str, int]]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def name_of(path: str) -> str:
    return posixpath.basename(path)


def extension_of(path: str) -> str:
    return posixpath.splitext(path)[1][1:].lower()


def packed(files: list[tuple[str, int]], most_bytes: int, most_files: int) -> list[Files]:
    """Partitions of up to so many bytes and files; a larger file is one by itself."""
    out: list[Files] = []
    held, total = [], 0
    for path, size in sorted(files, key=lambda f: (-f[1], f[0])):
        if held and (total + max(size, 0) > most_bytes or len(held) >= most_files):
            out.append(Files(held))
            held, total = [], 0
        held.append((path, size))
        total += max(size, 0)
    return [*out, Files(held)] if held else out


def decoded(data: bytes) -> tuple[str | None, str | None, str | None]:
    """(text, encoding, error)."""
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding), encoding, None
        except UnicodeDecodeError:
            continue
    return None, None, f"neither {' nor '.join(ENCODINGS)}"


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options.get("path")
        self.paths = [p for p in options.get("paths", "").split("\n") if p]
        self.extension = options.get("extension", "").lower()
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.files = int(options.get("partitionFiles", PARTITION_FILES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keeps what files can be told apart by; the rest goes back to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute in (("path",), ("name",), ("extension",)):
                self.filters.append(f)
            else:
                yield f

    def wanted(self, path: str) -> bool:
        of = {"path": path, "name": name_of(path), "extension": extension_of(path)}
        if self.extension and of["extension"] != self.extension:
            return False
        for f in self.filters:
            have = of[f.attribute[0]]
            if not (have == f.value if isinstance(f, EqualTo) else have in f.value if isinstance(f, In)
                    else have.startswith(f.value) if isinstance(f, StringStartsWith) else have.endswith(f.value)):
                return False
        return True

    def listed(self) -> list[tuple[str, int]]:
        if self.paths:
            found = []
            for p in self.paths:
                system, path = _open(p)
                info = system.get_file_info(path)
                found.append((p, info.size if info.type == fs.FileType.File else -1))
            return found
        system, folder = _open(self.folder)
        return [(f.path, f.size if f.type == fs.FileType.File else -1)
                for f in system.get_file_info(fs.FileSelector(folder, recursive=True)) if f.type != fs.FileType.Directory]

    def partitions(self) -> list[InputPartition]:
        return packed([f for f in self.listed() if self.wanted(f[0])], self.bytes, self.files)

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        for path, size in partition.paths if partition else []:  # None: there is no file at all
            system, place = _open(path if self.paths else self.folder)
            try:
                with system.open_input_stream(place if self.paths else path) as f:
                    text, encoding, error = decoded(f.read())
            except (OSError, pa.ArrowException) as e:
                text, encoding, error = None, None, type(e).__name__
            yield pa.RecordBatch.from_pylist([{
                "path": path, "name": name_of(path), "extension": extension_of(path), "size": size if size >= 0 else None,
                "encoding": encoding, "content": text, "error": error}], schema=ARROW)


ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("extension", pa.string()), ("size", pa.int64()),
                   ("encoding", pa.string()), ("content", pa.string()), ("error", pa.string())])


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class CorpusWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        system, folder = _open(self.folder)
        stage = f"{folder}/{self.staging}"
        system.create_dir(stage, recursive=True)
        names = []
        for row in iterator:
            data = row["content"] if isinstance(row["content"], (bytes, bytearray)) else row["content"].encode(row["encoding"])
            at = f"{stage}/{uuid.uuid4().hex}"  # of this attempt alone
            with system.open_output_stream(at) as f:
                f.write(bytes(data))
            names.append((at, row["name"]))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _open(self.folder)
        for message in messages:
            for at, name in message.names if message else []:
                system.create_dir(posixpath.dirname(f"{folder}/{name}"), recursive=True)
                system.move(at, f"{folder}/{name}")
        self._clear(system, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_open(self.folder))

    def _clear(self, system: fs.FileSystem, folder: str) -> None:
        if system.get_file_info(f"{folder}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/{self.staging}")


class CorpusSource(DataSource):
    """Options: path, or paths (one a line); extension (any case), partitionBytes, partitionFiles."""

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CorpusReader:
        return CorpusReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> CorpusWriter:
        return CorpusWriter(dict(self.options))
