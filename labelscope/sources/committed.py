"""Record files with a commit step, as a Python data source (IO3, IO8).

``committed_json`` stores rows as gzipped JSON lines, a file per task. A task
returns its file's name, rows and SHA-256; only when all tasks are done does the driver
put the manifest in place that names the files. Files of failed, repeated or
lost tasks are in no manifest, so readers never see them, and a run that
breaks off leaves the former table as it was. Reading is a partition per file;
a file that is cut or changed raises.

    spark.dataSource.register(CommittedJson)
    df.write.format("committed_json").mode("overwrite").save(path)      # or mode("append")
    spark.read.format("committed_json").load(path)

``path`` lies in a folder that all executors share, by any URI that ``pyarrow.fs`` opens.
Columns are strings, whole numbers, doubles, booleans and arrays of these; other
types raise before a task starts. The manifest (a line per file) passes through
the driver, rows do not.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType)

MANIFEST = "_manifest.json"
_PLAIN = (StringType, LongType, IntegerType, ShortType, DoubleType, FloatType, BooleanType)
# Numbers that JSON has no form for.
_SPECIAL = {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}


def _fs(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_manifest(path: str) -> dict:
    """``{"schema": ..., "files": [...]}`` of a committed table."""
    filesystem, root = _fs(path)
    with filesystem.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def _has_manifest(path: str) -> bool:
    from pyarrow import fs

    filesystem, root = _fs(path)
    return filesystem.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File


def _check_types(schema: StructType) -> None:
    for f in schema.fields:
        kind = f.dataType.elementType if isinstance(f.dataType, ArrayType) else f.dataType
        if not isinstance(kind, _PLAIN):
            raise ValueError(f"column {f.name}: {f.dataType.simpleString()} cannot be stored as JSON lines")


def _to_json(value):
    if isinstance(value, float) and not math.isfinite(value):
        return {"number": str(json.dumps(value))}
    return [_to_json(x) for x in value] if isinstance(value, (list, tuple)) else value


def _from_json(value):
    if isinstance(value, dict):
        return _SPECIAL[value["number"]]
    return [_from_json(x) for x in value] if isinstance(value, list) else value


@dataclass
class FileMessage(WriterCommitMessage):
    """What a task reports of its file."""

    name: str
    rows: int
    sha256: str


@dataclass
class FilePartition(InputPartition):
    """One file to read."""

    name: str
    rows: int
    sha256: str


class _Writer(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        _check_types(schema)
        self.path, self.schema, self.overwrite = path, schema, overwrite
        self.held = read_manifest(path) if not overwrite and _has_manifest(path) else None
        if self.held is not None and self.held["schema"] != json.loads(schema.json()):
            raise ValueError(f"{path} holds rows of another schema")

    def write(self, rows: Iterator) -> FileMessage:
        filesystem, root = _fs(self.path)
        filesystem.create_dir(root, recursive=True)
        name, n, digest = f"part-{uuid.uuid4().hex}.json.gz", 0, hashlib.sha256()
        with filesystem.open_output_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) as out:
            for row in rows:
                line = json.dumps([_to_json(x) for x in row], ensure_ascii=False).encode("utf-8", "surrogatepass") + b"\n"
                digest.update(line)
                out.write(line)
                n += 1
        return FileMessage(name, n, digest.hexdigest())

    def commit(self, messages: list) -> None:
        filesystem, root = _fs(self.path)
        filesystem.create_dir(root, recursive=True)
        files = [] if self.held is None else list(self.held["files"])
        files += [[m.name, m.rows, m.sha256] for m in messages if m is not None and m.rows]
        new = f"{root}/{MANIFEST}.{uuid.uuid4().hex}"
        with filesystem.open_output_stream(new) as f:
            f.write(json.dumps({"schema": json.loads(self.schema.json()), "files": files}).encode())
        filesystem.move(new, f"{root}/{MANIFEST}")  # the table changes here, at once

    def abort(self, messages: list) -> None:
        """Nothing to undo: files outside the manifest are not part of the table."""


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(*f) for f in read_manifest(self.path)["files"]]

    def read(self, partition: FilePartition | None) -> Iterator[tuple]:
        if partition is None:  # a table without files
            return
        filesystem, root = _fs(self.path)
        n, digest = 0, hashlib.sha256()
        with filesystem.open_input_stream(f"{root}/{partition.name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as lines:
            for line in lines:
                digest.update(line)
                n += 1
                yield tuple(_from_json(x) for x in json.loads(line.decode("utf-8", "surrogatepass")))
        if (n, digest.hexdigest()) != (partition.rows, partition.sha256):
            raise ValueError(f"{partition.name} is not the file that was committed")


class CommittedJson(DataSource):
    """The data source ``committed_json``."""

    @classmethod
    def name(cls) -> str:
        return "committed_json"

    def schema(self) -> StructType:
        return StructType.fromJson(read_manifest(self.options["path"])["schema"])

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, overwrite)
