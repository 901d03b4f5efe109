"""Column expressions over paths and dotted names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(qname: Column, by: str = ".") -> Column:
    """A name's parts."""
    return F.split(qname, f"[{by}]")


def parent(qname: Column, by: str = ".") -> Column:
    """A name without its last part; '' if it has one part."""
    p = parts(qname, by)
    return F.array_join(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), by)


def prefixes(qname: Column, by: str = ".") -> Column:
    """All prefixes of a name that end between parts, the name itself included, shortest first."""
    p = parts(qname, by)
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), by))


def first_part(qname: Column) -> Column:
    """The base package of a dotted name."""
    return F.substring_index(qname, ".", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def relative(path: Column, root: Column) -> Column:
    """A path without the root that it starts with, and without leading slashes."""
    return F.ltrim(F.when(path.startswith(root), F.substring(path, F.length(root) + F.lit(1), F.length(path))).otherwise(path), F.lit("/"))


def module_name(path: Column) -> Column:
    """The dotted name of a file or folder by its relative path; a suffix ``.py`` goes wherever it stands, as every slash becomes a dot."""
    return F.replace(F.replace(F.ltrim(path, F.lit("/")), F.lit(".py"), F.lit("")), F.lit("/"), F.lit("."))


def folder_name(path: Column) -> Column:
    return F.replace(F.ltrim(path, F.lit("/")), F.lit("/"), F.lit("."))


def legacy_file_name(path: Column, container: Column) -> Column:
    """The older name of a file below a folder: the container's path is taken out wherever it occurs."""
    return module_name(F.when(container == "", path).otherwise(F.replace(path, container, F.lit(""))))


def placeholder_id(qname: Column) -> Column:
    """The id that stands for a package until it is stored."""
    return F.concat(F.lit("package_"), F.replace(qname, F.lit("."), F.lit("_")))


def relative_base(module: Column, level: Column) -> Column:
    """The module that ``level`` leading dots refer to from ``module``; '' if there are too many."""
    p = parts(module)
    return F.when(level >= F.size(p), "").otherwise(F.array_join(F.slice(p, F.lit(1), F.size(p) - level), "."))


def node_id(node_type: str | Column, *key: Column) -> Column:
    """A deterministic id: the type, and a digest of what tells nodes of the type apart."""
    kind = F.lit(node_type) if isinstance(node_type, str) else node_type
    return F.concat(kind, F.lit("/"), F.substring(F.sha2(F.concat_ws("\x1f", kind, *[F.coalesce(k.cast("string"), F.lit("")) for k in key]), 256), 1, 24))


def append(array: Column, value: Column) -> Column:
    """The array, or an empty one, with one more value."""
    return F.array_append(F.coalesce(array, F.array()), value)


def append_new(array: Column, value: Column) -> Column:
    """As ``append``, unless the value is there already."""
    return F.array_distinct(append(array, value))
