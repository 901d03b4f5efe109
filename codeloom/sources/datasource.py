"""A Spark data source of source files: ``spark.read.format("source_files")`` and ``spark.readStream.format("source_files")``.

Options: ``path`` (the root), ``suffixes`` and ``patterns`` (JSON lists: what names may end with, and what is ignored), ``content`` (false:
names only).  A partition is a folder below the root, or the root's own files; its task lists and reads it, so the driver
lists one level.  Names that begin with ``_`` or ``.`` and empty files are found too.  As a stream, a file
arrives when its time of change lies behind that of the last batch, again if it changes again.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, InputPartition, StringEndsWith, StringStartsWith

from codeloom.sources.files import _file_system, pattern_regex

NAME = "source_files"
SCHEMA = "path string, content binary, length long, modified timestamp"
_ARROW = pa.schema([("path", pa.string()), ("content", pa.binary()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])


class Folder(InputPartition):
    """A folder (relative; '' for the root's own files alone) and the times of change (microseconds) behind ``after``, up to ``until``."""

    def __init__(self, folder: str, after: int | None = None, until: int | None = None):
        super().__init__(folder)
        self.folder, self.after, self.until = folder, after, until


class _Files:
    """What both readers do: list, choose and read."""

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.suffixes = json.loads(options["suffixes"]) if "suffixes" in options else None
        self.patterns = [(ignores, f"{regex}") for ignores, regex in map(pattern_regex, json.loads(options.get("patterns", "[]")))]
        self.content = options.get("content", "true").lower() != "false"
        self.starts: list[str] = []
        self.ends: list[str] = []

    def wants(self, path: str) -> bool:
        if self.suffixes is not None and not path.endswith(tuple(self.suffixes)):
            return False
        if not all(map(path.startswith, self.starts)) or not all(map(path.endswith, self.ends)):
            return False
        out = False
        for ignores, regex in self.patterns:
            out = ignores if re.fullmatch(regex, path) else out
        return not out

    def folders(self) -> list[str]:
        files, base = _file_system(self.root)
        found = files.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return ["", *sorted(i.path[len(base) :].lstrip("/") for i in found if i.type == fs.FileType.Directory)]

    def rows(self, part: Folder) -> Iterator[pa.RecordBatch]:
        files, base = _file_system(self.root)
        for i in files.get_file_info(fs.FileSelector(f"{base}/{part.folder}".rstrip("/"), recursive=bool(part.folder), allow_not_found=True)):
            path, changed = i.path[len(base) :].lstrip("/"), (i.mtime_ns or 0) // 1000
            new = (part.after is None or changed > part.after) and (part.until is None or changed <= part.until)
            if i.type == fs.FileType.File and new and self.wants(path):
                content = None
                if self.content:
                    with files.open_input_file(i.path) as f:
                        content = f.read()
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((path, content, i.size, changed), _ARROW.types, strict=True)], schema=_ARROW)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = _Files(options)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Beginnings and ends of paths are tested before a file is read; the rest is left to Spark."""
        for f in filters:
            if isinstance(f, StringEndsWith) and f.attribute == ("path",):
                self.files.ends.append(f.value)
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.files.starts.append(f.value)
            else:
                yield f

    def partitions(self) -> list[Folder]:
        return [Folder(f) for f in self.files.folders()]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return self.files.rows(partition)


class StreamReader(DataSourceStreamReader):
    """Offsets are times of change; what changed in the last ``settle_ms`` (1) waits for the next batch."""

    def __init__(self, options: dict):
        self.files, self.settle = _Files(options), int(options.get("settle_ms", "1"))

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() // 1000 - 1000 * self.settle}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return [Folder(f, start["until"], end["until"]) for f in self.files.folders()]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return self.files.rows(partition)


class SourceFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))


def register(spark: SparkSession) -> str:
    """Makes the source known to the session, and turns on there that such sources are given filters; returns its name."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceFiles)
    return NAME
