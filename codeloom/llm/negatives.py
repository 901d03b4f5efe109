"""Hard negatives: for an anchor and each of its positives, rows of other labels whose scores lie in a window below the positive's.

Scores are inner products.  Each vector x gets one component more, sqrt(m - x.x) with m the largest squared norm
of its stripe, and each anchor q a 0 there: then |q - x|^2 = m + q.q - 2 q.x, so that higher scores are nearer and a window
of scores is an annulus of distances.  The rows are dealt into stripes and the anchors into blocks; each stripe meets each block
in a task of its own, as a vantage-point tree: a node halves its rows by their distance to one of them and keeps the least and the
greatest distance of each half, which bound the distances of a half to any anchor.  An anchor takes up nodes and rows nearest
first, beginning at the inner edge of the annulus, and ends with the k-th row or at the outer edge.

Bounds decide only what is left unread, with room for rounding; scores are exact whole numbers.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import shared, topk

#: Rows of a stripe and anchors of a block, on average.
STRIPE, BLOCK = 4096, 2048
#: Rows of a leaf at most.
LEAF = 256

_PAIRS = "anchor_id long, positive_id long, id long, score long, positive_score long"


class Tree:
    """A vantage-point tree over norm-augmented rows; counts the rows whose scores anchors asked for."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, times: np.ndarray | None = None):
        order = np.lexsort((labels, ids))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.times = np.ones(len(ids), np.int64) if times is None else times[order]
        norms = (self.vectors**2).sum(axis=1)
        self.m = float(norms.max(initial=0))
        self.extra = np.sqrt(np.maximum(0, self.m - norms))
        self.largest = np.abs(self.vectors).max(axis=0, initial=0)
        self.read = 0
        #: Nodes: (rows, None, their vectors) of a leaf, else (vantage row, ((child, least, greatest distance to it), ...)).
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(ids)))

    def _distances(self, row: int, rows: np.ndarray) -> np.ndarray:
        inner = self.vectors[rows] @ self.vectors[row] + self.extra[rows] * self.extra[row]
        return np.sqrt(np.maximum(0, 2 * (self.m - inner)))

    def _build(self, rows: np.ndarray) -> int:
        todo: list[tuple[np.ndarray, int]] = [(rows, 0)]
        self.nodes.append(())
        while todo:  # no recursion, so that no input is too deep
            rows, place = todo.pop()
            if len(rows) <= LEAF:
                rows = np.sort(rows)
                self.nodes[place] = (rows, None, self.vectors[rows])
                continue
            # Of the row farthest from the first one, others lie far and near; halves are cut by rank, so equal rows are parted too.
            vantage = int(rows[np.argmax(self._distances(int(rows[0]), rows))])
            away = self._distances(vantage, rows)
            near = np.argsort(away, kind="stable")
            halves = []
            for part in np.array_split(near, 2):
                self.nodes.append(())
                todo.append((rows[part], len(self.nodes) - 1))
                halves.append((len(self.nodes) - 1, float(away[part[0]]), float(away[part[-1]])))
            self.nodes[place] = (vantage, tuple(halves))
        return 0

    def searcher(self, anchor: np.ndarray) -> Search:
        return Search(self, anchor)


class Search:
    """What one anchor has read of a tree; its windows share it."""

    def __init__(self, tree: Tree, anchor: np.ndarray):
        self.tree, self.anchor = tree, anchor
        self.square = float(anchor @ anchor)
        # Floating-point sums up to this size err by less than this.
        self.slack = 1e-9 * (tree.m + self.square) + 1e-6
        self.small = float(tree.largest @ np.abs(anchor)) < 2**52  # nothing is rounded
        self.scores: dict[int, np.ndarray] = {}
        self.away: dict[int, float] = {}

    def _to_vantage(self, row: int) -> float:
        if row not in self.away:
            self.away[row] = math.sqrt(max(0.0, self.tree.m + self.square - 2 * float(self.tree.vectors[row] @ self.anchor)))
        return self.away[row]

    def _leaf(self, node: int, vectors: np.ndarray) -> np.ndarray:
        if node not in self.scores:
            self.scores[node] = (vectors @ self.anchor).astype(np.int64) if self.small else topk.exact_products(vectors, self.anchor)
            self.tree.read += len(vectors)
        return self.scores[node]

    def nearest(self, take: np.ndarray, k: int, low: int | None = None, high: int | None = None) -> list[tuple[int, int]]:
        """The first ``k`` rows of those that ``take`` marks with scores from ``low`` to ``high``, as (score, id): higher scores first, ties by smaller ids.

        Nodes and rows stand in one queue by the most that they can score; what comes out of it is next.
        """
        tree, total = self.tree, self.tree.m + self.square
        # Squared distances of the annulus, widened.
        inner = 0.0 if high is None else max(0.0, total - 2 * high - self.slack)
        outer = math.inf if low is None else total - 2 * low + self.slack
        if outer < 0 or not len(tree.ids):
            return []
        begin, end = math.sqrt(inner), math.sqrt(outer) if outer < math.inf else math.inf
        room = math.sqrt(self.slack) + 1e-9 * (math.sqrt(total) + 1)  # a distance of a rounded square errs by this at most
        out: list[tuple[int, int]] = []
        #: (squared distance at least, row or -1, score, id of the row or the node)
        queue: list[tuple[float, int, int, int]] = [(inner, -1, 0, tree.root)]
        best: list[int] = []  # the k highest scores that were queued
        while queue and len(out) < k:
            _, row, score, at = heapq.heappop(queue)
            if row >= 0:
                out += [(score, at)] * min(k - len(out), int(tree.times[row]))
                continue
            node = tree.nodes[at]
            if node[1] is None:
                scores = self._leaf(at, node[2])
                good = take[node[0]]
                if (least := best[0] if len(best) == k else low) is not None:  # no less than ``low``
                    good = good & (scores >= least)
                if high is not None:
                    good = good & (scores <= high)
                found = np.flatnonzero(good)
                if len(found) > k:  # rows of a leaf stand by their ids
                    found = found[np.argsort(-scores[found], kind="stable")[:k]]
                for row, s in zip(node[0][found].tolist(), scores[found].tolist(), strict=True):
                    heapq.heappush(queue, (total - 2 * s + self.slack, row, s, int(tree.ids[row])))
                    (heapq.heappush if len(best) < k else heapq.heappushpop)(best, s)
                continue
            away = self._to_vantage(node[0])
            for child, least, greatest in node[1]:
                near = max(0.0, away - greatest - room, least - away - room)
                if near <= end and away + greatest + room >= begin:
                    heapq.heappush(queue, (max(near * near, inner), -1, 0, child))
        return out


def _vectors(table: pa.Table, column: str, width: int) -> np.ndarray:
    return topk._matrix(table[column], width)


def _search(k: int, of_own_label: bool):
    """Of each anchor in a block, rows of a stripe: the ``k`` nearest of its label, or for each of its positives the ``k`` nearest of others in its window."""

    def run(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [], [])
        if len(rows) and len(anchors):
            width = max(int(np.diff(c.combine_chunks().offsets.to_numpy()).max()) for c in (rows["v"], anchors["v"]))
            tree = Tree(rows["vec_id"].to_numpy(), rows["label"].to_numpy(), _vectors(rows, "v", width), rows["times"].to_numpy())
            vectors, positives = _vectors(anchors, "v", width), anchors["positives"].to_pylist()
            for a, (own, label) in enumerate(zip(anchors["vec_id"].to_pylist(), anchors["label"].to_pylist(), strict=True)):
                search = tree.searcher(vectors[a])
                take = (tree.labels == label) & (tree.ids != own) if of_own_label else tree.labels != label
                for p in [None] if of_own_label else positives[a]:
                    window = {} if p is None else {"low": p["low"], "high": p["high"]}
                    for score, id_ in search.nearest(take, k, **window):
                        for column, value in zip(out, (own, p and p["id"], id_, score, p and p["score"]), strict=True):
                            column.append(value)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out], names=["anchor_id", "positive_id", "id", "score", "positive_score"])

    return run


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, *, every: int = 100, positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Of each anchor (vec_id divisible by ``every``) and each of its ``positives`` best rows of the same label: the best ``k`` rows of other labels whose scores are ``low`` to ``high`` percent of the positive's.

    ``vectors`` has vec_id and label (long, not null) and ``v`` (see ``topk.whole``).  Returns anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score.  Scores are exact; ties go to smaller ids.  Of fewer rows there are fewer results; a positive
    score below 0 has an empty window.  Rows repeated under an anchor's id are not its positives, and of such an anchor the first row by label and
    vector asks; rows repeated under other ids count each, but as positives of one score once.  Shorter vectors are filled up with 0.  An empty table stays empty.  Scores that
    do not fit into 64 bits raise an error.  Work is anchors times rows, as every stripe meets every block, less what the trees leave unread.
    """
    n = vectors.count()
    stripes, blocks = max(1, -(-n // STRIPE)), max(1, -(-(n // every) // BLOCK))
    # Rows are dealt by their ids too, so that equal vectors spread; rows alike in all are one, with their number.
    deal = lambda of, count: F.pmod(F.xxhash64(F.lit(of), "vec_id", "v"), F.lit(count)).cast("int").alias(of)
    all_ = lambda count, of: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(of)
    rows = vectors.groupBy("vec_id", "label", "v").agg(F.count("*").alias("times"))
    rows = rows.select("vec_id", "label", "v", "times", deal("stripe", stripes), all_(blocks, "block")).groupBy("stripe", "block")
    first = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    first = shared.save(first, "anchors")

    def meet(anchors: DataFrame, run) -> DataFrame:
        held = anchors.select("vec_id", "label", "v", "positives", deal("block", blocks), all_(stripes, "stripe")).groupBy("stripe", "block")
        return rows.cogroup(held).applyInArrow(run, _PAIRS)

    window = "array<struct<id:bigint,score:bigint,low:bigint,high:bigint>>"
    near = shared.save(_best(meet(first.withColumn("positives", F.lit(None).cast(window)), _search(positives, True)), ["anchor_id"], positives), "positives")
    # low * p <= 100 * s <= high * p in whole numbers.
    least, most = F.expr(f"(score * {low} + 99) div 100"), F.expr(f"(score * {high}) div 100")
    mine = near.where("score >= 0").select("anchor_id", "id", "score").distinct().select(F.col("anchor_id").alias("vec_id"), F.struct("id", "score", least.alias("low"), most.alias("high")).alias("p"))
    asked = first.join(mine.groupBy("vec_id").agg(F.collect_list("p").alias("positives")), "vec_id")  # ``positives`` entries each
    found = _best(meet(asked, _search(k, False)), ["anchor_id", "positive_id", "positive_score"], k)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
