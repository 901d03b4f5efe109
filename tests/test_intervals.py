"""Interval joins against brute force, on hot keys and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import joins


def rows(seed, n):
    r = random.Random(seed)
    key = lambda: r.choice(["hot", "hot", "hot", "k", None])
    out = []
    for i in range(n):
        lo = r.choice([r.randrange(-60, 60), None]) if i % 17 == 0 else r.randrange(-60, 60)
        length = r.choice([0, 0, 1, 3, 9, 40, -2])
        out.append((i, key(), lo, None if i % 23 == 0 or lo is None else lo + length))
    return out


def brute(inner, outer):
    return sorted((a[0], b[0]) for a in inner for b in outer if None not in a and None not in b and a[1] == b[1] and a[2] <= a[3] and b[2] <= b[3] and a[2] >= b[2] and a[3] <= b[3])


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("kind", ["long", "double", "timestamp"])
def test_contained_equals_brute_force(spark, seed, kind):
    inner, outer = rows(seed, 150), rows(seed + 10, 90)
    inner += inner[:9]
    cast = lambda c: F.timestamp_seconds(c) if kind == "timestamp" else (F.col(c) / 4).cast(kind) if kind == "double" else F.col(c)
    frame = lambda x: spark.createDataFrame(x, "n long, key string, lo long, hi long").withColumns({"lo": cast("lo"), "hi": cast("hi")})
    i, o = frame(inner), frame(outer)
    want = brute(inner, outer)
    assert sorted(tuple(r) for r in joins.contained(i, o, ["key"], "lo", "hi").select("n", "outer_n").collect()) == want
    found = {a for a, _ in want}
    for how, ok in (("left_semi", True), ("left_anti", False)):
        for bucket in (None, F.floor(F.col("lo").cast("double") / 7)):
            got = sorted(r["n"] for r in joins.contained(i, o, ["key"], "lo", "hi", how, bucket).collect())
            assert got == sorted(n for n, *_ in inner if (n in found) == ok)


def test_contained_work_does_not_follow_the_product_of_a_key(spark):
    # 20,000 by 20,000 rows of one key, each inner one in two outer ones: a product would be 400 million comparisons.
    inner = spark.range(20_000).select(F.lit("k").alias("key"), (F.col("id") * 10 + 3).alias("lo"), (F.col("id") * 10 + 5).alias("hi"))
    outer = spark.range(20_000).select(F.lit("k").alias("key"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 15).alias("hi"))
    assert joins.contained(inner, outer, ["key"], "lo", "hi").count() == 39_999
    assert joins.contained(inner, outer, ["key"], "lo", "hi", "left_anti").count() == 0


def test_contained_refuses_other_joins_and_takes_empty_tables(spark):
    empty = spark.createDataFrame([], "key string, lo int, hi int")
    one = spark.createDataFrame([("k", 1, 2)], empty.schema)
    assert [joins.contained(a, b, ["key"], "lo", "hi", how).count() for a, b in ((one, empty), (empty, one)) for how in ("inner", "left_semi", "left_anti")] == [0, 0, 1, 0, 0, 0]
    with pytest.raises(ValueError, match="how"):
        joins.contained(one, one, ["key"], "lo", "hi", "full")
