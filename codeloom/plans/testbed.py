"""A graph from the star schema, to try graph operators on tables of any size.

Region, nation, customer, order, part and supplier become project, folder, file,
function, class and package.  ``NODES`` and ``EDGES`` say the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = """nodes AS (
    SELECT 'region/' || r_regionkey AS id, 'project' AS node_type, r_name AS name FROM region
    UNION ALL SELECT 'nation/' || n_nationkey, 'folder', n_name FROM nation
    UNION ALL SELECT 'customer/' || c_custkey, 'file', c_name FROM customer
    UNION ALL SELECT 'orders/' || o_orderkey, 'function', 'order ' || o_orderkey FROM orders
    UNION ALL SELECT 'part/' || p_partkey, 'class', p_name FROM part
    UNION ALL SELECT 'supplier/' || s_suppkey, 'package', s_name FROM supplier
)"""
EDGES = """edges AS (
    SELECT 'contains/' || 'nation/' || n_nationkey AS id, 'contains' AS edge_type, 'region/' || n_regionkey AS from_id, 'nation/' || n_nationkey AS to_id FROM nation
    UNION ALL SELECT 'contains/' || 'customer/' || c_custkey, 'contains', 'nation/' || c_nationkey, 'customer/' || c_custkey FROM customer
    UNION ALL SELECT 'contains/' || 'orders/' || o_orderkey, 'contains', 'customer/' || o_custkey, 'orders/' || o_orderkey FROM orders
    UNION ALL SELECT 'calls', 'calls', 'orders/' || l_orderkey, 'part/' || l_partkey FROM lineitem
    UNION ALL SELECT 'uses_import', 'uses_import', 'orders/' || l_orderkey, 'supplier/' || l_suppkey FROM lineitem
    UNION ALL SELECT 'belongs_to', 'belongs_to', 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    kinds = [("region", "r_regionkey", "project", F.col("r_name")), ("nation", "n_nationkey", "folder", F.col("n_name")), ("customer", "c_custkey", "file", F.col("c_name")), ("orders", "o_orderkey", "function", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))), ("part", "p_partkey", "class", F.col("p_name")), ("supplier", "s_suppkey", "package", F.col("s_name"))]
    out = None
    for name, key, kind, label in kinds:
        rows = t(name).select(_id(name, key).alias("id"), F.lit(kind).alias("node_type"), label.alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return out


def edges(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    """All edges, or those of some types, whose tables alone are then read."""
    t = lambda name: table(spark, sf_dir, name)

    def rows(edge_type: str, source: DataFrame, f: Column, to: Column, id: Column) -> DataFrame:
        return source.select(id.alias("id"), F.lit(edge_type).alias("edge_type"), f.alias("from_id"), to.alias("to_id"))

    child = lambda x: F.concat(F.lit("contains/"), x)
    nation, customer, order = _id("nation", "n_nationkey"), _id("customer", "c_custkey"), _id("orders", "o_orderkey")
    every = {
        "contains": [
            lambda: rows("contains", t("nation"), _id("region", "n_regionkey"), nation, child(nation)),
            lambda: rows("contains", t("customer"), _id("nation", "c_nationkey"), customer, child(customer)),
            lambda: rows("contains", t("orders"), _id("customer", "o_custkey"), order, child(order)),
        ],
        "calls": [lambda: rows("calls", t("lineitem"), _id("orders", "l_orderkey"), _id("part", "l_partkey"), F.lit("calls"))],
        "uses_import": [lambda: rows("uses_import", t("lineitem"), _id("orders", "l_orderkey"), _id("supplier", "l_suppkey"), F.lit("uses_import"))],
        "belongs_to": [lambda: rows("belongs_to", t("nation"), nation, _id("region", "n_regionkey"), F.lit("belongs_to"))],
    }
    out = None
    for kind, makers in every.items():
        for make in makers if not types or kind in types else []:
            out = make() if out is None else out.unionByName(make())
    return out
