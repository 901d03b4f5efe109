"""Intermediate tables in the one folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one, on a local master only."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="codeloom-") if sc.applicationId not in _own else "")


def save(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, written as Parquet and reread, its lineage cut."""
    spark = df.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files, which else stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def at(spark: SparkSession, path: str):
    """A path and the file system that it is on, as Hadoop has them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def forget(*saved: DataFrame) -> None:
    """Deletes the files of saved tables that nothing will read again."""
    for df in saved:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path, files = at(df.sparkSession, folder)
            files.delete(path, True)
