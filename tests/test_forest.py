"""Nested intervals of forests against brute force: deep, wide, odd."""

import random

import pytest

from codeloom.operators import forest
from codeloom.sources import work


def frame(spark, pairs):
    return spark.createDataFrame([(f, t) for f, t in pairs], "from_id string, to_id string")


def brute(pairs):
    """Of each node: its parent, root, depth, and all nodes below with their distance."""
    parent = {t: f for f, t in pairs if f is not None and t is not None}
    nodes = {*parent, *parent.values()}
    out = {n: [parent.get(n), n, 0, {}] for n in nodes}
    for n in nodes:
        at, hops = n, 0
        while at in parent:
            at, hops = parent[at], hops + 1
            out[at][3][n] = hops
        out[n][1:3] = [at, hops]
    return out


def checked(spark, pairs):
    rows = forest.numbered(frame(spark, pairs))
    got, want = {r["id"]: r for r in rows.collect()}, brute(pairs)
    assert {k: (r["parent_id"], r["root_id"], r["depth"]) for k, r in got.items()} == {k: tuple(v[:3]) for k, v in want.items()}
    of = {}
    for r in got.values():
        of.setdefault(r["root_id"], []).append(r)
    for tree in of.values():  # gapless numbers, and each interval holds what lies below
        assert sorted(r["first"] for r in tree) == list(range(len(tree)))
        by = {r["first"]: r["id"] for r in tree}
        for r in tree:
            assert {by[k] for k in range(r["first"] + 1, r["last"] + 1)} == set(want[r["id"]][3])
    return rows, want


@pytest.mark.parametrize("seed", range(2))
def test_forest_equals_brute_force(spark, seed):
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(max(0, i - r.choice([2, 9, 300])), i)}", f"n{i}") for i in range(1, 300) if i % 60]
    pairs += pairs[:20] + [(None, "n1"), ("n1", None), (None, None)]
    rows, want = checked(spark, pairs)
    starts = [f"n{i}" for i in range(0, 300, 7)] + ["unknown", "n0"]
    got = forest.below(rows, spark.createDataFrame([(s,) for s in starts], "start_id string"))
    expect = sorted((s, n, want[n][0], d) for s in set(starts) - {"unknown"} for n, d in want[s][3].items())
    assert sorted(map(tuple, got.collect())) == expect
    one = sorted(map(tuple, forest.below(rows, "n0", max_depth=3).collect()))
    assert one == sorted(("n0", n, want[n][0], d) for n, d in want["n0"][3].items() if d <= 3)
    up = forest.above(rows, rows.select("id"))
    assert sorted(map(tuple, up.collect())) == sorted((n, a, d) for a, v in want.items() for n, d in v[3].items())
    assert forest.below(rows, "unknown").isEmpty()


def test_rounds_follow_the_digits_of_the_depth(spark, monkeypatch):
    saves, save = [], work.save
    monkeypatch.setattr(work, "save", lambda df, name: (saves.append(name), save(df, name))[1])
    checked(spark, [(f"{i}", f"{i + 1}") for i in range(12)])
    few = len(saves)
    checked(spark, [(f"{i}", f"{i + 1}") for i in range(190)])
    assert len(saves) - 2 * few <= 8  # 16 times as deep: four rounds of two tables each


def test_wide_nodes_and_their_children(spark):
    checked(spark, [("top", f"c{i}") for i in range(3000)] + [("c7", f"d{i}") for i in range(40)])


def test_what_is_no_forest_is_refused(spark):
    with pytest.raises(ValueError, match="more than one parent: c"):
        forest.numbered(frame(spark, [("a", "c"), ("b", "c")]))
    with pytest.raises(ValueError, match="cycle above"):
        forest.numbered(frame(spark, [("r", "s"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]))
    with pytest.raises(ValueError, match="cycle above a"):
        forest.numbered(frame(spark, [("a", "a")]))
    assert forest.numbered(frame(spark, [])).isEmpty()
