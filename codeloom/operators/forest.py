"""Nested intervals of a forest, so that descendants and ancestors are one range join.

Each node gets the interval [first, last] of the numbers of its subtree in pre-order.  Pointer doubling
makes them: in each round every node looks twice as far up, so rounds are as many as the depth has binary digits, not
as the tree is deep.  Sizes come first, from what lies 1, 2, 4 ... levels below; a node's number is then the sum, along its way
from the root, of what its elder siblings hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators import joins
from codeloom.sources import work

#: Parts that the children of one node are dealt to, so that no task orders all children of a wide node.
PARTS = 256


def numbered(edges: DataFrame) -> DataFrame:
    """Of each node of a forest (edges from_id, to_id): id, parent_id, root_id, depth (roots: 0), first, last.

    The nodes below one are those of its root whose ``first`` is above its own and not above its ``last``.  Siblings are
    in an order of their own that is the same each time.  Parallel edges count once, edges with a null end not at all; nodes without an
    edge are not known here.  Two parents of one node or a cycle raise ValueError.  An empty table stays empty.
    """
    links = edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("parent_id")).dropna().distinct()
    links = work.save(links, "links")
    if (twice := links.groupBy("id").count().where("count > 1").first()) is not None:
        raise ValueError(f"more than one parent: {twice['id']}")
    roots = links.select(F.col("parent_id").alias("id")).distinct().join(links, "id", "left_anti")
    nodes = links.unionByName(roots, allowMissingColumns=True)
    # Of 2 ** k levels: the ancestor that far up, the steps to the farthest one and itself, and the nodes less than that far below.
    one = F.lit(1).cast("long")
    level = nodes.select("id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.coalesce("parent_id", "id").alias("root_id"), one.alias("size"))
    level = work.save(level, "levels")
    levels, total = [level], level.count()
    while not level.where("up IS NOT NULL").isEmpty():
        if 1 << (len(levels) - 1) > total:
            raise ValueError(f"cycle above {level.where('up IS NOT NULL').first()['id']}")
        below = level.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("more"))
        above = level.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("rest"), F.col("root_id").alias("top"))
        step = level.join(above, "up", "left").join(below, "id", "left")
        depth = (F.col("depth") + F.coalesce("rest", F.lit(0))).alias("depth")
        level = work.save(step.select("id", F.col("next").alias("up"), depth, F.coalesce("top", "root_id").alias("root_id"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "levels")
        levels.append(level)
    labelled = nodes.join(level.drop("up"), "id")
    children = labelled.where("parent_id IS NOT NULL").select("id", "parent_id", "size", F.pmod(F.xxhash64("id"), F.lit(PARTS)).alias("part"))
    parts = children.groupBy("parent_id", "part").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("parent_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("parent_id", "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    elder = Window.partitionBy("parent_id", "part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    children = children.withColumn("elder", F.coalesce(F.sum("size").over(elder), F.lit(0))).join(parts, ["parent_id", "part"])
    place = labelled.select("id").join(children.select("id", (F.col("before") + F.col("elder") + 1).alias("own")), "id", "left").select("id", F.coalesce("own", F.lit(0)).alias("first"))
    place = work.save(place, "places")
    for far in levels[:-1]:
        above = place.select(F.col("id").alias("up"), F.col("first").alias("rest"))
        step = place.join(far.select("id", "up"), "id").join(above, "up", "left")
        place = work.save(step.select("id", (F.col("first") + F.coalesce("rest", F.lit(0))).alias("first")), "places")
    out = labelled.join(place, "id")
    return work.save(out.select("id", "parent_id", "root_id", F.col("depth").cast("int").alias("depth"), "first", (F.col("first") + F.col("size") - 1).alias("last")), "forest")


def below(forest: DataFrame, start: str | DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """Descendants of a node, or of those in column ``start_id`` (each once): start_id, id, parent_id, depth (from the start, from 1).

    ``forest`` is what ``numbered`` returned.  One node: one scan against its interval.  Many: an interval join, whose work
    follows the pairs that come out.  Starts that the forest does not know have none below.
    """
    if isinstance(start, str):
        own = F.broadcast(forest.where(F.col("id") == start).select("root_id", *[F.col(c).alias(f"outer_{c}") for c in ("id", "depth", "first", "last")]))  # one row at most
        pairs = forest.join(own, "root_id").where((F.col("first") > F.col("outer_first")) & (F.col("first") <= F.col("outer_last")))
    else:
        outer = forest.join(start.select(F.col("start_id").alias("id")).distinct(), "id", "left_semi")
        pairs = joins.contained(forest, outer, ["root_id"], "first", "last").where(F.col("first") > F.col("outer_first"))
    out = pairs.select(F.col("outer_id").alias("start_id"), "id", "parent_id", (F.col("depth") - F.col("outer_depth")).alias("depth"))
    return out if max_depth is None else out.where(F.col("depth") <= max_depth)


def above(forest: DataFrame, ids: DataFrame) -> DataFrame:
    """Ancestors of the nodes in column ``id`` (each once): id, ancestor_id, hops (from 1)."""
    inner = forest.join(ids.select("id").distinct(), "id", "left_semi")
    pairs = joins.contained(inner, forest, ["root_id"], "first", "last").where(F.col("first") > F.col("outer_first"))
    return pairs.select("id", F.col("outer_id").alias("ancestor_id"), (F.col("depth") - F.col("outer_depth")).alias("hops"))
