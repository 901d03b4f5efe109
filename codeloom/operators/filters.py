"""Point reads, filters, limits and projections over node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.sources import work


def matches(filters: dict) -> Column:
    """All fields equal their values; NULL equals NULL.  Dotted names reach into structs."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in filters.items()], F.lit(True))


def find(table: DataFrame, filters: dict | None = None, limit: int | None = None, order: str | None = None) -> DataFrame:
    """Rows that equal all ``filters`` (none: all rows), at most ``limit``: the first ones by ``order``, if it is given, else any."""
    rows = table.where(matches(filters)) if filters else table
    if limit is None:
        return rows
    return rows.limit(limit) if order is None else rows.orderBy(order).limit(limit)


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``place``, each row's number (from 1) in the order of ``by``; rows alike there take numbers in any order.

    The rows are sorted by range into parts, numbered in each, and moved on by the sizes of the parts before, so that no task
    holds them all.
    """
    parts = work.save(rows.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "ranked")
    before = parts.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*by))
    return parts.withColumn("__own", own).join(before, "__part").withColumn("place", F.col("__own") + F.col("__before")).drop("__part", "__own", "__n", "__before")


def find_one(table: DataFrame, filters: dict | None = None, order: str = "id") -> DataFrame:
    """The first match by ``order``, or no row."""
    return find(table, filters).orderBy(order).limit(1)


def get(table: DataFrame, key: str) -> DataFrame:
    """The row of an id; no row if there is none.

    A key without a type is the part of an id behind its type; of several types that have it, the first in order counts.
    """
    if "/" in key:
        return table.where(F.col("id") == key).limit(1)
    return find_one(table.where((F.col("id") == key) | F.col("id").endswith(f"/{key}")))


def of_type(nodes: DataFrame, node_type: str) -> DataFrame:
    return nodes.where(F.col("node_type") == node_type)


def resolved_uses(edges: DataFrame) -> DataFrame:
    """``uses_import`` edges that name a target."""
    return edges.where((F.col("edge_type") == "uses_import") & (F.coalesce(F.col("target_qname"), F.lit("")) != ""))


def node_view(nodes: DataFrame) -> DataFrame:
    """The properties that handles show; ``absolute_path`` is path and name without a separator."""
    return nodes.select("id", "node_type", "name", "qname", "path", F.concat("path", "name").alias("absolute_path"))


def with_parent(rows: DataFrame) -> DataFrame:
    """Each row as one ``vertex`` struct beside its ``parent_id``."""
    return rows.select(F.struct(*[c for c in rows.columns if c != "parent_id"]).alias("vertex"), "parent_id")


#: Names at the boundary to document stores.
EXTERNAL = {"id": "_id", "key": "_key", "from_id": "_from", "to_id": "_to"}


def to_external(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({k: v for k, v in EXTERNAL.items() if k in rows.columns})


def from_external(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({v: k for k, v in EXTERNAL.items() if v in rows.columns})


def invalid_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of unknown type, or without what their type requires, and why."""
    known = F.col("node_type").isin(*schema.NODE_TYPES)
    missing = reduce(lambda a, kv: a.when((F.col("node_type") == kv[0]) & reduce(lambda x, y: x | y, [F.col(c).isNull() for c in ["name", "qname", *kv[1]]]), "missing property"), schema.REQUIRED.items(), F.when(~known, "unknown type"))
    return nodes.withColumn("reason", missing).where(F.col("reason").isNotNull()).select("id", "node_type", "reason")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select(F.col("id").alias("node"))
    return edges.join(ids, F.col("from_id") == F.col("node"), "left_anti").unionByName(edges.join(ids, F.col("to_id") == F.col("node"), "left_anti")).distinct()
