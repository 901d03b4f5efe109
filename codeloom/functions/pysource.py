"""What one Python source file holds, as plain rows.

A file is parsed once and walked once; the rows say only what stands where.
What names mean across imports, scopes and files is left to joins (``plans.scan``).
"""

from __future__ import annotations

import ast
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom import schema

#: kind: class, function, import, from, usage, call, assign, flow or error.  seq: the order of the walk.
#: scopes: classes and functions around, outermost first, by kind and dotted path in the file.
ROWS = T.StructType([
    T.StructField("kind", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("alias", T.StringType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("chain", T.ArrayType(T.StringType())),
    T.StructField("position", schema.POSITION),
    T.StructField("scopes", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("path", T.StringType())]))),
])


def position(node: ast.AST) -> dict:
    line, col = node.lineno, node.col_offset
    return {"line_no": line, "col_offset": col, "end_line_no": getattr(node, "end_lineno", None) or line, "end_col_offset": col if getattr(node, "end_col_offset", None) is None else node.end_col_offset}


def dotted(node: ast.AST) -> list[str]:
    """The names of an attribute chain that starts at a name, else nothing."""
    out = []
    while isinstance(node, ast.Attribute):
        out.append(node.attr)
        node = node.value
    return [*out, node.id][::-1] if isinstance(node, ast.Name) else []


class _Walk:
    def __init__(self, wants: frozenset[str] | None = None):
        self.rows, self.seq, self.wants, self.scopes, self.classes, self.in_function = [], 0, wants, [], [], 0

    def put(self, kind: str, node: ast.AST, *, name=None, alias=None, level=None, chain=None) -> None:
        if self.wants is None or kind in self.wants:
            self.rows.append((kind, self.seq, name, alias, level, chain, tuple(position(node).values()), self.scopes))
        self.seq += 1

    def visit(self, node) -> None:
        if own := _VISITS.get(type(node)):
            own(self, node)
        else:
            self.generic_visit(node)

    def generic_visit(self, node) -> None:
        for f in node._fields:
            value = getattr(node, f, None)
            if isinstance(value, ast.AST):
                self.visit(value)
            elif isinstance(value, list):
                for x in value:
                    if isinstance(x, ast.AST):
                        self.visit(x)

    def inside(self, kind: str, name: str, node: ast.AST) -> None:
        around = self.scopes
        self.scopes = [*around, (kind, ".".join([*self.classes, name]))]  # a list of its own, which rows share
        if kind == "class":
            self.classes.append(name)
        else:
            self.in_function += 1
        self.generic_visit(node)
        if kind == "class":
            self.classes.pop()
        else:
            self.in_function -= 1
        self.scopes = around

    def visit_ClassDef(self, node):
        if not self.in_function:
            self.put("class", node, name=node.name)
        self.inside("class", node.name, node)

    def visit_FunctionDef(self, node):
        if not self.in_function:
            self.put("function", node, name=node.name)
        self.inside("function", node.name, node)

    def visit_Import(self, node):
        for a in node.names:
            self.put("import", node, name=a.name, alias=a.asname or a.name)

    def visit_ImportFrom(self, node):
        for a in node.names:
            self.put("from", node, name=a.name, alias=a.asname or a.name, level=node.level, chain=None if node.module is None else [node.module])

    def visit_Name(self, node):
        if isinstance(node.ctx, ast.Load):
            self.put("usage", node, name=node.id, chain=[node.id])

    def visit_Attribute(self, node):
        chain = dotted(node)
        if chain and isinstance(node.ctx, ast.Load):
            self.put("usage", node, name=node.attr, chain=chain)
            self.generic_visit(node)

    def visit_Call(self, node):
        if chain := dotted(node.func):
            self.put("call", node, name=chain[-1], chain=chain)
        self.generic_visit(node)

    def visit_Assign(self, node):
        value = dotted(node.value.func) if isinstance(node.value, ast.Call) else []
        for target in node.targets:
            if value and isinstance(target, ast.Name):
                self.put("assign", node, name=target.id, chain=value)
        self.generic_visit(node)

    def visit_If(self, node):
        self.put("flow", node, name="if", alias="else" if node.orelse else "implicit_else")
        self.generic_visit(node)

    def _loop(self, node):
        self.put("flow", node, name=type(node).__name__.lower())
        self.generic_visit(node)

    visit_For = visit_While = visit_Try = visit_With = visit_Return = visit_Raise = _loop


_VISITS = {getattr(ast, k.removeprefix("visit_")): f for k, f in vars(_Walk).items() if k.startswith("visit_")} | {k: lambda walk, node: None for k in (ast.Load, ast.Store, ast.Del, ast.Constant, ast.Pass)}


def _source_tuples(text: str | None, wants: frozenset[str] | None = None) -> list[tuple]:
    """The rows of one source as values in the order of ``ROWS``."""
    walk = _Walk(wants)
    try:
        walk.visit(ast.parse(text or ""))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [("error", 0, type(e).__name__, str(e), None, None, None, [])]
    return walk.rows


def source_rows(text: str | None) -> list[dict]:
    """All rows of one source; of one that cannot be parsed, an error row."""
    out = [dict(zip(ROWS.names, r, strict=True)) for r in _source_tuples(text)]
    for r in out:
        r["position"] = None if r["position"] is None else dict(zip(schema.POSITION.names, r["position"], strict=True))
        r["scopes"] = [{"kind": kind, "path": path} for kind, path in r["scopes"]]
    return out


def tasks(spark: SparkSession) -> int:
    """How many tasks sources are dealt over."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(files: DataFrame, dealt: bool) -> DataFrame:
    """Path, module and content, dealt over all tasks if they are not: what a join or a small file left in one would be parsed there alone."""
    own = files.select("path", "module", "content")
    return own if dealt else own.repartition(tasks(files.sparkSession), "path")


#: Rows that go to Spark at once.
ROWS_AT_ONCE = 16_384


def in_batches(rows_of: Callable[[str | None, str], list[tuple]], arrow: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches of (path, module, content) that gives the path, the module and the values of ``rows_of`` for each row of a file, column by column."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        collects = gc.isenabled()
        gc.disable()  # trees hold no cycles, and a search for some takes more time than parsing
        try:
            held: list[tuple] = []
            for given in batches:
                for path, module, content in zip(*(given.column(c) for c in ("path", "module", "content")), strict=True):
                    path, module = path.as_py(), module.as_py()
                    rows = rows_of(content.as_py(), module or "")
                    for k in range(0, len(rows), ROWS_AT_ONCE):
                        held += [(path, module, *r) for r in rows[k : k + ROWS_AT_ONCE]]
                        if len(held) >= ROWS_AT_ONCE:
                            yield batch(held)
                            held = []
            if held:
                yield batch(held)
        finally:
            if collects:
                gc.enable()

    return run


def extract(files: DataFrame, kinds: Iterable[str] | None = None, *, bound_only: bool = False, dealt: bool = False) -> DataFrame:
    """The rows (of some kinds, if any are named) of each file of (path, module, content), with its path and module.

    ``bound_only``: usages of names that no import of the file binds are left out.  ``dealt``: the files lie in many tasks as they are.
    """
    out = T.StructType([T.StructField("path", T.StringType()), T.StructField("module", T.StringType()), *ROWS.fields])
    arrow, wants = to_arrow_schema(out), None if kinds is None else frozenset(kinds)

    def rows_of(content: str | None, module: str) -> list[tuple]:
        rows = _source_tuples(content, wants)
        if bound_only:
            bound = {r[3] for r in rows if r[0] in ("import", "from")}
            rows = [r for r in rows if r[0] != "usage" or r[5][0] in bound]
        return rows

    return spread(files, dealt).mapInArrow(in_batches(rows_of, arrow), out)


def register(spark: SparkSession, name: str = "python_source") -> None:
    """Makes the walk a table function for SQL: ``SELECT t.* FROM files, LATERAL python_source(content) t``."""

    class PythonSource:
        def eval(self, content: str):
            for r in source_rows(content):
                yield r["kind"], r["seq"], r["name"], r["alias"], r["level"], r["chain"], r["position"], r["scopes"]

    spark.udtf.register(name, F.udtf(PythonSource, returnType=ROWS))
