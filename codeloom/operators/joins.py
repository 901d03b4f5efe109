"""Neighbour, symbol, as-of, interval and prefix joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import names

DIRECTIONS = ("OUTBOUND", "INBOUND", "ANY")


def neighbours(edges: DataFrame, nodes: DataFrame, start: str | DataFrame, direction: str = "OUTBOUND", node_type: str | None = None) -> DataFrame:
    """Nodes one edge away, a row for each edge.

    ``start`` is an id, or a table of ``start_id``, which the result then carries.  ANY is both
    directions together, so that a loop at the start counts twice.  Edges to missing nodes give no row.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}")
    if direction == "ANY":
        return neighbours(edges, nodes, start, "OUTBOUND", node_type).unionByName(neighbours(edges, nodes, start, "INBOUND", node_type))
    near, far = ("from_id", "to_id") if direction == "OUTBOUND" else ("to_id", "from_id")
    ends = edges.select(F.col(near).alias("start_id"), F.col(far).alias("__far"))
    ends = ends.where(F.col("start_id") == start).drop("start_id") if isinstance(start, str) else ends.join(start.select("start_id"), "start_id")
    to = nodes if node_type is None else nodes.where(F.col("node_type") == node_type)
    return ends.join(to, F.col("__far") == F.col("id")).drop("__far")


def latest(symbols: DataFrame) -> DataFrame:
    """One row (qname, id) for each name: the last that was registered."""
    return symbols.groupBy("qname").agg(F.max_by("id", F.struct("seq", "id")).alias("id"))


def known_symbols(symbols: DataFrame) -> DataFrame:
    """All names that are registered, each once."""
    return symbols.select("qname").distinct()


def file_imports(bindings: DataFrame, by: str = "path", alias: str = "alias", value: str = "qname") -> DataFrame:
    """Of each file, its imports as one map from alias to the name bound last (by ``seq``): columns ``by`` and imports."""
    last = bindings.groupBy(by, alias).agg(F.max_by(value, "seq").alias("value"))
    return last.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(alias, "value"))).alias("imports"))


def clear_imports(bindings: DataFrame, files: DataFrame, by: str = "path") -> DataFrame:
    """The bindings without those of the given files."""
    return bindings.join(files.select(by).distinct(), by, "left_anti")


def look_up(rows: DataFrame, symbols: DataFrame, qname: str, id: str = "id") -> DataFrame:
    """Adds the id of each row's name, null if the name is unknown."""
    return rows.join(latest(symbols).select(F.col("qname").alias(qname), F.col("id").alias(id)), qname, "left")


def as_of(usages: DataFrame, bindings: DataFrame, by: list[str], value: Column, first: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """Adds to each usage the ``value`` of the last binding before it (``bound``) and, if asked, of ``first`` of the earliest (``first``).

    Both sides have the columns ``by`` and an order ``seq``; of equal ``seq``, a binding comes after.  Usages
    without a binding are dropped.  Both sides are laid into one order for each key and read once, so that the
    work does not grow with the product of a key's usages and bindings.

    ``bucket``, an expression that never falls as ``seq`` grows (the day of a time), splits keys of many rows: each bucket
    is ordered by itself, and what earlier ones bound comes in as one more binding, from an aggregate of a row a bucket.
    """
    own = bindings.select(*by, "seq", F.struct(value.alias("v")).alias("__value"), F.struct((value if first is None else first).alias("v")).alias("__first"), F.lit(True).alias("__binding"))
    rows = usages.withColumn("__binding", F.lit(False)).unionByName(own, allowMissingColumns=True)
    keys, order = by, ["seq", "__binding"]
    if bucket is not None:
        keys, order = [*by, "__bucket"], ["__here", *order]
        rows = rows.withColumns({"__bucket": bucket, "__here": F.lit(True)})
        at = F.when(F.col("__binding"), F.struct("seq"))  # a struct, so that a null seq counts as the least
        held = rows.groupBy(*keys).agg(F.max_by("__value", at).alias("__value"), F.min_by("__first", at).alias("__first"))
        earlier = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = held.select(*keys, F.last("__value", ignorenulls=True).over(earlier).alias("__value"), F.first("__first", ignorenulls=True).over(earlier).alias("__first"), F.lit(True).alias("__binding"), F.lit(False).alias("__here"))
        rows = rows.unionByName(carried.where(F.col("__value").isNotNull()), allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"bound": F.last("__value", ignorenulls=True).over(before), "first": F.first("__first", ignorenulls=True).over(before)})
    rows = rows.where(~F.col("__binding") & F.col("bound").isNotNull())
    return rows.select(*usages.columns, F.col("bound.v").alias("bound"), *([F.col("first.v").alias("first")] if first is not None else []))


def _whole(df: DataFrame, c: str) -> Column:
    """The column as whole numbers that keep its order."""
    kind = dict(df.dtypes)[c]
    return F.unix_micros(c) if kind == "timestamp" else F.unix_date(c).cast("long") if kind == "date" else F.floor(c).cast("long")


def contained(inner: DataFrame, outer: DataFrame, by: list[str], lo: str, hi: str, how: str = "inner", bucket: Column | None = None) -> DataFrame:
    """Interval join: inner rows whose [lo, hi] lies in an outer row's, in the same ``by``; outer columns get the prefix ``outer_``.

    ``how`` is inner, left_semi or left_anti.  No work grows with the product of a key's rows.  Pairs: an outer
    interval lies in one or two bins of the power of two next to its length, an inner one begins in one bin of each size that its
    key has outer ones of; so only intervals of one bin meet.  Semi and anti join: in the order of ``lo``, an inner row is contained if the
    largest ``hi`` of the outer rows up to it is no less than its own; each side is read once.  There ``bucket``,
    an expression that never falls as ``lo`` grows, splits keys of many rows; what earlier buckets hold comes in as one row a bucket.

    Null bounds, null keys and intervals with hi below lo are contained in nothing and contain nothing.
    """
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError("how must be one of inner, left_semi, left_anti")
    outer = outer.where(F.col(lo) <= F.col(hi))
    for c in by:
        outer = outer.where(F.col(c).isNotNull())
    return _containing_pairs(inner, outer, by, lo, hi) if how == "inner" else _swept(inner, outer, by, lo, hi, how == "left_semi", bucket)


def _containing_pairs(inner: DataFrame, outer: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    first, last = _whole(outer, lo), _whole(outer, hi)
    level = F.length(F.bin(last - first))  # a bin of 2 ** level holds the interval, or two do
    o = outer.withColumns({"__level": level, "__first": first, "__last": last})
    o = o.withColumn("__bin", F.explode(F.array_distinct(F.array(F.expr("shiftright(__first, __level)"), F.expr("shiftright(__last, __level)")))))
    o = o.select("__level", "__bin", *[F.col(c).alias(f"outer_{c}") for c in outer.columns])
    levels = outer.select(*[F.col(c).alias(f"outer_{c}") for c in by], level.alias("__level")).distinct()
    same = lambda left, right: reduce(lambda x, y: x & y, [left[c] == right[f"outer_{c}"] for c in by], F.lit(True))
    i = inner.where(F.col(lo) <= F.col(hi))
    i = i.join(levels, same(i, levels)).select(*inner.columns, F.col("__level").alias("__of"), _whole(inner, lo).alias("__lo"))
    i = i.withColumn("__at", F.expr("shiftright(__lo, __of)"))
    on = same(i, o) & (i["__of"] == o["__level"]) & (i["__at"] == o["__bin"]) & (i[lo] >= o[f"outer_{lo}"]) & (i[hi] <= o[f"outer_{hi}"])
    return i.join(o, on).select(*[i[c] for c in inner.columns], *[o[f"outer_{c}"] for c in outer.columns])


def _swept(inner: DataFrame, outer: DataFrame, by: list[str], lo: str, hi: str, semi: bool, bucket: Column | None) -> DataFrame:
    rows = inner.withColumn("__most", F.lit(None).cast(dict(outer.dtypes)[hi])).withColumn("__inner", F.lit(True))
    own = outer.select(*by, lo, F.col(hi).alias("__most"), F.lit(False).alias("__inner"))
    rows = rows.unionByName(own, allowMissingColumns=True)
    keys, order = by, [lo, "__inner"]
    if bucket is not None:
        keys, order = [*by, "__bucket"], ["__here", *order]
        rows = rows.withColumns({"__bucket": bucket, "__here": F.lit(True)})
        held = rows.groupBy(*keys).agg(F.max("__most").alias("__most"))
        before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = held.select(*keys, F.max("__most").over(before).alias("__most"), F.lit(False).alias("__inner"), F.lit(False).alias("__here"))
        rows = rows.unionByName(carried.where(F.col("__most").isNotNull()), allowMissingColumns=True)
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.coalesce(F.max("__most").over(upto) >= F.col(hi), F.lit(False)) & F.coalesce(F.col(lo) <= F.col(hi), F.lit(False))
    return rows.withColumn("__in", inside).where(F.col("__inner") & (F.col("__in") == semi)).select(*inner.columns)


def _known_names(known: DataFrame) -> DataFrame:
    """Names (q, exact): all known names (exact) and all their proper prefixes (not exact)."""
    rows = known.select(F.col("qname").alias("n")).distinct().select(F.explode(names.prefixes(F.col("n"))).alias("q"), "n")
    return rows.groupBy("q").agg(F.max(F.col("q") == F.col("n")).alias("exact"))


def local(targets: DataFrame, known: DataFrame, qname: str = "target_qname") -> DataFrame:
    """Targets that a project holds: known themselves, below a known name, or above one.

    Both sides are exploded to their prefixes and joined by equality, where a comparison of
    all pairs by ``startswith`` would grow with the product of both.
    """
    have = _known_names(known)
    q = targets.select(F.col(qname).alias("t")).distinct()
    below = q.select("t", F.explode(names.prefixes(F.col("t"))).alias("q")).join(have.where("exact"), "q", "left_semi").select("t")
    above = q.join(have, F.col("t") == F.col("q"), "left_semi").select("t")
    return targets.join(below.unionByName(above).distinct(), F.col(qname) == F.col("t"), "left_semi")


def external(targets: DataFrame, known: DataFrame, qname: str = "target_qname") -> DataFrame:
    """The complement of ``local``."""
    inside = local(targets.select(qname).distinct(), known, qname).select(F.col(qname).alias("t"))
    return targets.join(inside, F.col(qname) == F.col("t"), "left_anti")


def unresolved(local_targets: DataFrame, symbols: DataFrame, qname: str = "target_qname") -> DataFrame:
    """Local targets that no symbol names exactly: they get no edge, and are reported."""
    return local_targets.join(symbols.select(F.col("qname").alias("s")), F.col(qname) == F.col("s"), "left_anti")


def package_targets(external_targets: DataFrame, packages: DataFrame, qname: str = "target_qname") -> DataFrame:
    """External targets with the id of the package of their first part."""
    p = packages.select(F.col("qname").alias("base"), F.col("id").alias("package_id"))
    return external_targets.join(p, names.first_part(F.col(qname)) == F.col("base")).drop("base")
