"""Extracts rows from source files as they arrive."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from codeloom.functions import pysource
from codeloom.sources import datasource
from codeloom.sources import files as source_files


def source_stream(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """New and changed ``.py`` files below ``root``, ``__init__.py`` included, as a stream of (path, module, content)."""
    stream = spark.readStream.format(datasource.register(spark)).option("suffixes", '[".py"]').option("patterns", json.dumps(patterns or []))
    return source_files.read_sources(stream.load(root))[0]


def keep_rows(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the rows of every file that arrives to a Parquet table, exactly once."""
    return pysource.extract(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
