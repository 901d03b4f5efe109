"""Whether a graph is a project's: cycles of containment, nodes that no project holds, several parents, loose ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.sources import work


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges (f, t) that are left once nodes that nothing leads to, or that lead nowhere, are taken off again and again."""
    n = edges.count()
    while True:
        ahead, behind = edges.select(F.col("f").alias("t")).distinct(), edges.select(F.col("t").alias("f")).distinct()
        left = work.save(edges.join(ahead, "t", "left_semi").join(behind, "f", "left_semi"), "trimmed")
        if (m := left.count()) == n:
            return left
        edges, n = left, m


def components(edges: DataFrame) -> DataFrame:
    """Strongly connected components of two nodes or more, and loops: id, component (its largest id).

    Forward and backward: every node takes the largest id that leads to it, by rounds of what changed; the nodes of one
    such colour that lead back to that id, inside the colour, are its component.  They are taken off, what is left is trimmed, and so on.  Edges that lie
    in no cycle go with the first trimming, so that the rounds work on little where cycles are rare.
    """
    left = trimmed(work.save(edges.select(F.col("from_id").alias("f"), F.col("to_id").alias("t")).distinct(), "ends"))
    spark = edges.sparkSession
    out = [spark.createDataFrame([], "id string, component string")]
    while not left.isEmpty():
        colour = work.save(left.select(F.col("f").alias("id")).unionByName(left.select(F.col("t").alias("id"))).distinct().withColumn("colour", F.col("id")), "colour")
        changed = colour
        while not changed.isEmpty():
            offered = left.join(changed, F.col("f") == F.col("id")).groupBy("t").agg(F.max("colour").alias("new"))
            merged = work.save(colour.join(offered, F.col("id") == F.col("t"), "left").select("id", F.greatest("colour", "new").alias("colour"), F.coalesce(F.col("new") > F.col("colour"), F.lit(False)).alias("moved")), "colour")
            colour, changed = merged.select("id", "colour"), merged.where("moved").select("id", "colour")
        of = lambda side: colour.select(F.col("id").alias(side), F.col("colour").alias(f"{side}_colour"))
        inside = work.save(left.join(of("f"), "f").join(of("t"), "t").where("f_colour = t_colour").select("f", "t"), "inside")
        level = work.save(colour.where("id = colour").select("id", F.col("colour").alias("component")), "back")
        found = [level]
        while not level.isEmpty():
            step = inside.join(level, F.col("t") == F.col("id")).select(F.col("f").alias("id"), "component").distinct()
            level = work.save(step.join(reduce(DataFrame.unionByName, found), "id", "left_anti"), "back")
            found.append(level)
        own = work.save(reduce(DataFrame.unionByName, found), "component")
        out.append(own)
        gone = own.select("id")
        left = trimmed(left.join(gone.withColumnRenamed("id", "f"), "f", "left_anti").join(gone.withColumnRenamed("id", "t"), "t", "left_anti"))
    every = reduce(DataFrame.unionByName, out)
    loops = edges.where("from_id = to_id").select(F.col("from_id").alias("id")).distinct().withColumn("alone", F.lit(True))
    sizes = every.groupBy("component").agg(F.count("*").alias("n"))
    # Of a component of one node, only a loop is a cycle.
    return every.join(sizes, "component").join(loops, "id", "left").where("n > 1 OR alone").select("id", "component")


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """All ids that edges lead to from ``starts`` (id), these included; by a frontier and what was seen."""
    edges = edges.select("from_id", "to_id")
    seen = level = work.save(starts.select("id").distinct(), "seen")
    while not level.isEmpty():
        step = edges.join(level, F.col("from_id") == F.col("id")).select(F.col("to_id").alias("id")).distinct()
        level = work.save(step.join(seen, "id", "left_anti"), "seen")
        seen = seen.unionByName(level)
    return seen


def faults(nodes: DataFrame, contains: DataFrame) -> DataFrame:
    """What is wrong with a graph's containment: id, fault, detail.

    cycle (detail: the largest id in it), several_parents (their number), unreachable (no project holds it; packages
    need none), missing (an edge's end that no node is; detail: the edge).  A project has no parent: one that has is reported as held.
    """
    row = lambda df, fault, detail: df.select("id", F.lit(fault).alias("fault"), detail.cast("string").alias("detail"))
    none = F.lit(None)
    parents = contains.select("to_id", "from_id").distinct().groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("n"))
    projects = nodes.where("node_type = 'project'").select("id")
    held = reached(contains, projects)
    ends = contains.select(F.explode(F.array("from_id", "to_id")).alias("id"), F.col("id").alias("edge"))
    return reduce(DataFrame.unionByName, [
        row(components(contains), "cycle", F.col("component")),
        row(parents.where("n > 1"), "several_parents", F.col("n")),
        row(parents.join(projects, "id", "left_semi"), "held", F.col("n")),
        row(nodes.where("node_type <> 'package'").join(held, "id", "left_anti"), "unreachable", none),
        row(ends.join(nodes.select("id"), "id", "left_anti"), "missing", F.col("edge")),
    ])
