"""Exact top-k inner products by no-random-access aggregation of sorted lists.

The rows are dealt into stripes and the queries into blocks; every stripe meets every block of
queries in a task of its own, whose size is bounded.  In it each dimension is a list of the stripe's
rows sorted by value.  A query reads the lists in step, each from its favourable end, block by block.  For
each row it keeps a lower and an upper bound of its score (what is read, and what the
unread part can at least and at most add), and it stops reading when rows outside of a few
candidates cannot qualify, however deep that is; at the lists' ends the bounds meet.  The
candidates' scores are then resolved exactly.

The unread part is bounded twice: by the lists' frontiers and far ends, and by the norms of what is
unread (each list entry carries its row's squared norm).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
#: Every how many ids a row is a query.
EVERY = 50
#: Rows of a stripe and queries of a block, on average.
STRIPE, BLOCK = 4096, 1024
#: Shares of each list at which the bounds are compared.
DEPTHS = (1 / 16, 1 / 4, 1 / 2, 3 / 4, 7 / 8, 1)
#: Queries that read in step.
TOGETHER = 32
#: Reading stops when the candidates are at most this share of the rows, or 4 k.
FEW = 1 / 32

FOUND = "query_id long, vec_id long, score long"


class Lists:
    """A stripe's vectors as one sorted list for each dimension; counts the entries read and the rows resolved.

    Queries read in step, so what they have read at some depth of a list is the same entries for all
    that read it from the same end: the sums over a block of entries are taken for many queries at once.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        places = np.argsort(self.vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.vectors, places, axis=0)
        self.ranks = np.empty(places.shape, np.int32)
        np.put_along_axis(self.ranks, places, np.arange(len(ids), dtype=np.int32)[:, None], axis=0)
        self.norms = (self.vectors**2).sum(axis=1)
        self.largest = np.abs(self.vectors).max(axis=0, initial=0)
        self.depths = sorted({max(1, math.ceil(len(ids) * x)) for x in DEPTHS})
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.read = self.resolved = 0

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The values of the entries that round ``k`` reads, from the lists' highest ends and from their lowest, and which rows are read by then."""
        if k not in self.blocks:
            from_top, end = len(self.ids) - 1 - self.ranks.T, self.depths[k]
            shown = np.concatenate([from_top < end, self.ranks.T < end])
            fresh = shown & ~self.block(k - 1)[1].astype(bool) if k else shown
            self.blocks[k] = np.concatenate([self.vectors.T] * 2) * fresh, shown.astype(np.float64)
        return self.blocks[k]

    def candidates(self, queries: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of queries by rows: which of ``others`` may be among a query's ``k`` best; which queries read the lists to their ends; all sums of what was read."""
        n = len(self.ids)
        live, sums, read_norm = others.copy(), np.zeros(others.shape), np.zeros(others.shape)
        ended = np.zeros(len(queries), bool)
        open_ = np.flatnonzero(others.sum(axis=1) > k)
        sides = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1)  # read from the highest end, from the lowest
        slack = 1e-6 + 1e-12 * (np.abs(queries) @ self.largest)[:, None]
        for r, depth in enumerate(self.depths):
            if not len(open_):
                break
            values, shown = self.block(r)
            q = sides[open_]
            sums[open_] += q @ values
            self.read += int((q != 0).sum()) * (depth - (self.depths[r - 1] if r else 0))
            if depth == n:
                ended[open_] = True
                break
            read_norm[open_] += (q != 0).astype(np.float64) @ (values * values)
            edge = np.concatenate([self.sorted[n - 1 - depth], self.sorted[depth]]) * q
            far = np.concatenate([self.sorted[0], self.sorted[-1]]) * q
            read_far, read_edge, read_query = np.split(np.concatenate([far, edge, q * q]) @ shown, 3)
            # What rounding may have taken from the norms of the rest is added.
            rest = np.maximum(0, self.norms * (1 + 1e-13) - read_norm[open_]) * np.maximum(0, (q * q).sum(axis=1, keepdims=True) * (1 + 1e-13) - read_query)
            rest, known, own = np.sqrt(rest) * (1 + 1e-9) + slack[open_], sums[open_], others[open_]
            low = np.where(own, known + np.maximum(-rest, far.sum(axis=1, keepdims=True) - read_far - slack[open_]), -np.inf)
            low.partition(n - k, axis=1)
            high = known + np.minimum(rest, edge.sum(axis=1, keepdims=True) - read_edge + slack[open_])
            own &= high >= low[:, n - k, None]
            live[open_] = own
            open_ = open_[own.sum(axis=1) > max(4 * k, n * FEW)]
        live[ended] = others[ended]
        return live, ended, sums

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, row ids and exact scores of the ``k`` best rows other than the query's own; ties to smaller ids."""
        out = ([], [], [])
        for at in range(0, len(queries), TOGETHER):
            ids, some = query_ids[at : at + TOGETHER], queries[at : at + TOGETHER]
            live, ended, sums = self.candidates(some, self.ids != ids[:, None], k)
            for j, (own, query) in enumerate(zip(ids, some, strict=True)):
                rows = np.flatnonzero(live[j])  # in the order of their ids
                if ended[j] and np.abs(query) @ self.largest < 2**52:
                    scores = sums[j, rows].astype(np.int64)  # nothing was rounded
                else:
                    scores = exact_products(self.vectors[rows], query)
                    self.resolved += len(rows)
                order = np.lexsort((rows, -scores))[:k]
                out[0].append(np.full(len(order), own))
                out[1].append(self.ids[rows[order]])
                out[2].append(scores[order])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def exact_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products: in floating point where no sum can be rounded, else in whole numbers of any size.

    Raises OverflowError if one does not fit into 64 bits.
    """
    if not len(vectors) or np.abs(vectors).max(axis=0, initial=0) @ np.abs(query) < 2**52:
        return (vectors @ query).astype(np.int64)
    whole = [int(x) for x in query]
    products = [sum(int(x) * y for x, y in zip(v, whole, strict=True)) for v in vectors]
    if max(map(abs, products)) >= 2**63:
        raise OverflowError("an inner product does not fit into 64 bits")
    return np.array(products, np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix, filled up with 0."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _searcher(k: int):
    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(rows) and len(queries):
            width = max(int(np.diff(c.combine_chunks().offsets.to_numpy()).max()) for c in (rows["v"], queries["v"]))
            lists = Lists(rows["vec_id"].to_numpy(), _matrix(rows["v"], width))
            out = lists.best(queries["vec_id"].to_numpy(), _matrix(queries["v"], width), k)
        columns = [pa.array(x, pa.int64()) for x in out]
        return pa.Table.from_arrays(columns, names=["query_id", "vec_id", "score"])

    return run


def whole(vectors: DataFrame, column: str = "embedding", scale: float = 256.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, the columns of ``keep`` and ``v``, the components times ``scale`` rounded down; rows without id or vector, and those with a null or non-finite component, are left out."""
    x = F.transform(F.col(column), lambda c: c.cast("double"))
    infinite = float("inf")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == infinite))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull()).where(~F.coalesce(bad, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), *keep, F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))


def top_k(vectors: DataFrame, *, k: int = K, every: int = EVERY) -> DataFrame:
    """The ``k`` rows of largest inner product with each query: query_id, rank (from 1), vec_id, score.

    ``vectors`` has vec_id and ``v`` (see ``whole``).  Queries are the rows whose id is divisible by
    ``every``; all rows of other ids are candidates, ties go to smaller ids, and a query has
    fewer results if there are fewer candidates.  Rows repeated under a query's id count as the
    query's own; shorter vectors are filled up with 0.  A query's repeated rows ask once.  Scores that do
    not fit into 64 bits raise an error.
    """
    n = vectors.count()
    queries = vectors.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-(n // every) // BLOCK))
    stripes = max(1, -(-n // STRIPE))
    number = lambda name, of, count: F.pmod(F.xxhash64(F.lit(name), "vec_id", "v"), F.lit(count)).cast("int").alias(of)
    others = lambda count, of: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(of)
    left = vectors.select("vec_id", "v", number("stripe", "stripe", stripes), others(blocks, "block"))
    right = queries.dropDuplicates(["vec_id"]).select("vec_id", "v", number("block", "block", blocks), others(stripes, "stripe"))
    found = left.groupBy("stripe", "block").cogroup(right.groupBy("stripe", "block")).applyInArrow(_searcher(k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
