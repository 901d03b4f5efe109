"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Source parts are the partitions that Spark reads the rows in.  How many rows go from each part to each
shard is drawn exactly (multivariate hypergeometric), so that the counts are those of a uniform
permutation of all rows; each part then permutes its rows locally (a sort within the
partition, without a shuffle) and hands them out by those counts.  Within its shard a row falls into a
cell by a hash of its place in the part's permutation; the cells of a shard stand end to end, and each permutes
what it got.  So whole rows are moved once, and a cell is small enough for a task.  Places alone decide the cells, so they are
counted without reading a column.  The driver sees one number for each part and shard and one for each cell, never a row.
"""

from __future__ import annotations

import json
import math
import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import shared

#: Source parts whose rows fill a cell, on average.
PARTS_PER_CELL = 2
#: Bits that number the rows of a partition in ``monotonically_increasing_id``.
ROW_BITS = 33


def hypergeometric(draw: random.Random, good: int, bad: int, n: int) -> int:
    """How many of ``n`` items drawn from ``good + bad`` without replacement are good; any size."""
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mean = n * good / total
    spread = 12 * math.sqrt(max(1.0, mean * (bad / total) * ((total - n) / max(1, total - 1)))) + 30
    k = np.arange(max(low, int(mean - spread)), min(high, int(mean + spread)) + 1, dtype=np.float64)
    # Ratios of neighbouring probabilities; the ends left out weigh less than 1e-30.
    steps = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - n + k[:-1] + 1)
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(weights - weights.max()))
    return int(k[min(len(k) - 1, int(np.searchsorted(weights, draw.random() * weights[-1], side="right")))])


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows from each part to each shard: row sums ``parts``, column sums ``shards``."""
    draw, left, out = random.Random(seed), list(shards), []
    for n in parts:
        row, rest = [], sum(left)
        for s, room in enumerate(left):
            rest -= room
            take = hypergeometric(draw, room, rest, n)
            row.append(take)
            left[s] -= take
            n -= take
        out.append(row)
    return out


def shard_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def _table(spark, rows: list[dict], kind: str) -> DataFrame:
    return spark.sql(f"SELECT inline(from_json(:rows, 'array<struct<{kind}>>'))", args={"rows": json.dumps(rows)})


def assign_shards(rows: DataFrame, by: list[str], n_shards: int = 16, seed: int = 20_011, *, stable: bool = False) -> DataFrame:
    """Adds ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes differ by one row at most, and every arrangement is as likely as
    any other.  ``by`` names the columns whose values the permutations are drawn from (nulls
    allowed); rows alike in all of them are told apart by their other columns.  No row is dropped; an
    empty table stays empty; all columns are carried, texts of any length included.  A
    column named ``shard`` or ``slot`` is refused; other names never clash.

    The rows are read twice, first to count them.  ``stable`` says that they come from files
    alone and fall into the same partitions each time; otherwise they are saved first.
    The driver draws one number for each partition and shard.
    """
    if clash := {"shard", "slot"} & {c.lower() for c in rows.columns}:
        raise ValueError(f"columns that the result adds exist already: {sorted(clash)}")
    names = rows.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")  # one column, so that no name can clash
    held = (rows if stable else shared.save(rows, "shard-rows")).select(row)
    digest = F.min(F.xxhash64(*[F.col("row").getField(c) for c in by]))
    parts = held.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), digest.alias("digest")).collect()  # one row for each part
    counts = {r["part"]: r["n"] for r in parts}
    # By what they hold: which number a part gets may follow from the order in which files are listed.
    order = [r["part"] for r in sorted(parts, key=lambda r: (r["digest"], r["n"], r["part"]))]
    matrix = communication_matrix([counts[p] for p in order], shard_sizes(sum(counts.values()), n_shards), seed)
    spark = rows.sparkSession
    ends = [{"part": p, "place": k, "ends": np.cumsum(m).tolist()} for k, (p, m) in enumerate(zip(order, matrix, strict=True))]
    ends = F.broadcast(_table(spark, ends, "part:int,place:int,ends:array<bigint>"))  # n_shards numbers for each partition read
    per_shard = max(1, math.ceil(len(order) / PARTS_PER_CELL / n_shards))
    number = [F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("rank")]
    mixed = lambda k: F.xxhash64(F.lit(seed + k), "place", "rank")

    def deal(numbered: DataFrame) -> DataFrame:
        shard = F.size(F.filter("ends", lambda end: end <= F.col("rank"))).alias("shard")
        return numbered.join(ends, "part").select("*", shard, F.pmod(mixed(3), F.lit(per_shard)).alias("cell"))

    found = deal(held.select(*number)).groupBy("shard", "cell").count().orderBy("shard", "cell").collect()  # one row for each cell
    cells, total = [], dict.fromkeys(range(n_shards), 0)
    for r in found:
        cells.append({"shard": r["shard"], "cell": r["cell"], "first": total[r["shard"]]})
        total[r["shard"]] += r["count"]
    cells = F.broadcast(_table(spark, cells, "shard:int,cell:bigint,first:bigint"))
    own = [F.col("row").getField(c) for c in by]
    # The whole row decides where ``by`` does not, so that a task that runs again deals alike.
    whole = F.xxhash64(F.to_json("row") if "map<" in rows.schema.simpleString() else F.col("row"))
    dealt = deal(held.sortWithinPartitions(F.xxhash64(F.lit(seed + 1), *own), *own, whole).select("row", *number)).join(cells, ["shard", "cell"])
    # Each cell is permuted alone and takes the slots after those of the shard's earlier cells.
    again = Window.partitionBy("shard", "first").orderBy(mixed(2), "place", "rank")
    return dealt.select(*[F.col("row").getField(c).alias(c) for c in names], "shard", (F.col("first") + F.row_number().over(again) - 1).alias("slot"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """Writes assigned rows as one folder for each shard; the rows of a file stand in the order of their slots."""
    assigned.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
