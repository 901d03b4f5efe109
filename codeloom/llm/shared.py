"""Work files in the one folder that the driver and all executors share.

The folder is the one the session names in ``spark.checkpoint.dir`` (see ``sources.work``).
"""

from __future__ import annotations

import ctypes
import gc
import mmap
import posixpath
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from codeloom.sources.work import root


def new_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, *, rows: int | None = None, each: int = 50_000) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and returns it reread.

    This cuts the lineage: a lost executor costs only the tasks that it ran.  If ``rows``, the most
    rows that there can be, is known, tasks of ``each`` rows write it, lest many tasks write tiny files.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    if rows is not None:
        df = df.coalesce(min(rows // each + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*saved: DataFrame) -> None:
    """Deletes the files of saved tables that nothing will read again."""
    for df in saved:
        for folder in {posixpath.dirname(f) for f in df.inputFiles()}:
            files, path = _open(folder)
            files.delete_dir(path)


def unused(name: str, columns: Sequence[str]) -> str:
    """``name``, lengthened until none of ``columns`` bears it, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def aside(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns of these names renamed, and what each of those was called, to name them back."""
    back: dict[str, str] = {}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            back[unused(f"own_{c}", [*df.columns, *names, *back])] = c
    return df.withColumnsRenamed({c: new for new, c in back.items()}), back


#: What this worker keeps between tasks, in tables of one operator.
_kept: dict | None = None


def let_go(own: dict | None = None) -> None:
    """Empties what the worker's earlier tasks kept in a table other than ``own``, and hands free memory back to the system.

    Workers outlive their tasks and serve one stage after the other; what one operator keeps would else
    stand beside the needs of all that follow.
    """
    global _kept
    if _kept is own and own is not None:
        return
    if _kept is not None:
        _kept.clear()
        gc.collect()
    _kept = own
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


class AtomicFile:
    """A file that appears under its name only when it is whole.

    A task that runs twice writes the same bytes twice; the last one to end
    replaces the first, and a reader never sees part of a file.
    """

    def __init__(self, uri: str):
        self.files, self.path = _open(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        self.files.create_dir(posixpath.dirname(self.path), recursive=True)
        self.stream = self.files.open_output_stream(self.temp)
        return self.stream

    def __exit__(self, kind, *_):
        self.stream.close()
        if kind is None:
            self.files.move(self.temp, self.path)
        else:
            self.files.delete_file(self.temp)


def write_file(uri: str, data: bytes) -> None:
    with AtomicFile(uri) as out:
        out.write(data)


def read_file(uri: str) -> bytes:
    files, path = _open(uri)
    with files.open_input_file(path) as f:
        return f.read()


def map_file(uri: str):
    """The file's bytes: memory-mapped where the file system allows it, else read."""
    files, path = _open(uri)
    if not isinstance(files, fs.LocalFileSystem):
        return read_file(uri)
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
