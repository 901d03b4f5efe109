"""Strongly connected components, faults and assembled trees against plain search."""

import json
import random

import pytest

from codeloom.operators import graph, validate


def frame(spark, pairs):
    return spark.createDataFrame([(f"e{k}", a, b) for k, (a, b) in enumerate(pairs)], "id string, from_id string, to_id string")


def reach(pairs, start):
    seen, todo = set(), [start]
    while todo:
        x = todo.pop()
        for a, b in pairs:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_mutual_reach(spark, seed):
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(14)}", f"n{r.randrange(14)}") for _ in range(r.choice([12, 18]))] + [("a", "b"), ("b", "c"), ("c", "a"), ("c", "x"), ("x", "y"), ("y", "x"), ("l", "l"), ("n1", "a"), ("y", "l")]
    of = {x: reach(pairs, x) for p in pairs for x in p}
    want = {x: max(y for y in of if y == x or (y in of[x] and x in of[y])) for x in of if x in of[x]}
    assert {r["id"]: r["component"] for r in validate.components(frame(spark, pairs)).collect()} == want


def test_faults(spark):
    nodes = spark.createDataFrame([("p", "project"), ("a", "folder"), ("b", "file"), ("c", "file"), ("q", "project"), ("k", "package"), ("z", "file")], "id string, node_type string")
    edges = frame(spark, [("p", "a"), ("a", "b"), ("b", "a"), ("p", "c"), ("a", "c"), ("p", "q"), ("c", "none")])
    got = {(r["id"], r["fault"], r["detail"]) for r in validate.faults(nodes, edges).collect()}
    assert got == {("a", "cycle", "b"), ("b", "cycle", "b"), ("a", "several_parents", "2"), ("c", "several_parents", "2"), ("q", "held", "1"), ("z", "unreachable", None), ("none", "missing", "e6")}
    assert validate.faults(nodes.limit(0), edges.limit(0)).count() == 0


def test_assembled_trees(spark):
    roots = spark.createDataFrame([("r",), ("alone",)], "start_id string")
    nodes = spark.createDataFrame([(x, f'say "{x}"') for x in ("r", "a", "b", "c", "alone")], "id string, name string")
    edges = frame(spark, [("r", "a"), ("r", "b"), ("r", "b"), ("a", "c"), ("b", "c"), ("b", "missing"), ("other", "r")])
    leaf = lambda x, *c: {"id": x, "name": f'say "{x}"', "children": list(c)}
    b = leaf("b", leaf("c"))
    trees = graph.assembled(edges, roots, nodes)
    assert {r["start_id"]: json.loads(r["t"]) for r in trees.selectExpr("start_id", "to_json(tree) AS t").collect()} == {"r": leaf("r", leaf("a", leaf("c")), b, b), "alone": leaf("alone")}
    assert sorted((r["parent_id"], r["id"], r["depth"]) for r in graph.tree_edges(trees).collect()) == [("a", "c", 2), ("b", "c", 2), ("b", "c", 2), ("r", "a", 1), ("r", "b", 1), ("r", "b", 1)]
    with pytest.raises(ValueError, match="cycle"):
        graph.assembled(frame(spark, [("r", "a"), ("a", "r")]), roots)
    assert graph.assembled(edges, roots.limit(0)).count() == 0
