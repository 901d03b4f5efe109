"""Explicit schemas of the graph tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

POSITION = T.StructType([T.StructField(n, T.IntegerType()) for n in ("line_no", "col_offset", "end_line_no", "end_col_offset")])
#: Position of edges between containers and folders or files.
ZERO_POSITION = (0, 0, 0, 0)

_S = T.StringType()

NODES = T.StructType([
    T.StructField("id", _S, False),
    T.StructField("node_type", _S, False),
    T.StructField("name", _S),
    T.StructField("qname", _S),
    T.StructField("path", _S),
    T.StructField("position", POSITION),
    T.StructField("inputs", T.ArrayType(T.VariantType())),
    T.StructField("outputs", T.ArrayType(T.VariantType())),
    T.StructField("fields", T.ArrayType(T.VariantType())),
    T.StructField("version", _S),
    T.StructField("source", _S),
    T.StructField("imported_paths", T.ArrayType(_S)),
])

EDGES = T.StructType([
    T.StructField("id", _S, False),
    T.StructField("edge_type", _S, False),
    T.StructField("from_id", _S, False),
    T.StructField("to_id", _S, False),
    T.StructField("position", POSITION),
    T.StructField("target_symbol", _S),
    T.StructField("target_qname", _S),
    T.StructField("alias", _S),
    T.StructField("import_position", POSITION),
    T.StructField("usage_positions", T.ArrayType(POSITION)),
])

SYMBOLS = T.StructType([T.StructField("qname", _S), T.StructField("id", _S), T.StructField("seq", T.LongType())])
FILE_IMPORTS = T.StructType([T.StructField("file_id", _S), T.StructField("alias", _S), T.StructField("qname", _S), T.StructField("seq", T.LongType()), T.StructField("import_position", POSITION)])
ISSUES = T.StructType([T.StructField("path", _S), T.StructField("kind", _S), T.StructField("detail", _S)])

NODE_TYPES = ("project", "folder", "file", "function", "class", "package")
EDGE_TYPES = ("belongs_to", "contains", "calls", "uses_import", "implements")
#: Columns that a node of each type must fill besides name and qname.
REQUIRED = {"project": ["path"], "folder": ["path"], "file": ["path"], "function": ["position"], "class": ["position"], "package": []}
