"""Periodic runs of words: stretches that repeat with one smallest period several times over.

Every run has a Lyndon root, under the order of the words or under the reverse order: a stretch of one period
that is smaller than all its rotations.  The longest Lyndon word that starts at each place is found with a stack,
scanned from right to left; two suffixes are compared by their longest common extension (LCE), found by binary
search over rolling hashes and verified word by word, and the same extension, to both sides, turns a
root into its run.  What was verified for a distance between two places is kept, so that no stretch is
verified twice for one distance.  There is no suffix array.

Words that no run can hold are told first: each four words in a row inside of a run come again in its document.
Stretches between such words are scanned one by one, so the work follows the repeated text, not the whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.llm import words

#: Words of a run at least, and its periods.
SHORTEST, PERIODS = 6, 4
#: Four words in a row of a run come again in it.
GRAM = 4
#: Words that two places are compared over before hashes are.
NEAR = 8

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
#: What ``find_runs`` adds.
ADDED = T.StructType([
    T.StructField("n_words", T.LongType(), False),
    T.StructField("runs", T.ArrayType(RUN, False), False),
    T.StructField("collapsed", T.StringType(), False),
])


class Stretch:
    """Words as numbers, with hashes of all their prefixes."""

    def __init__(self, words_: np.ndarray):
        n = len(words_)
        self.array, self.words, self.n = words_, words_.tolist(), n
        powers = np.cumprod(np.concatenate([[1], np.full(n, _BASE, np.uint64)]).astype(np.uint64))
        self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(words.mix(words_.astype(np.uint64) + np.uint64(1)) * powers[:n])]).tolist()
        self.powers = powers.tolist()
        #: Of each distance d, the last stretch [lo, hi) of places x whose words equal those at x + d, as long as can be.
        self.alike: dict[int, tuple[int, int]] = {}

    def _right(self, i: int, j: int) -> int:
        """How many words from ``i`` and ``j`` on (i < j) are alike: hashes by binary search, then the words themselves."""
        w, n, h = self.words, self.n, self.prefix
        for k in range(min(NEAR, n - j)):
            if w[i + k] != w[j + k]:
                return k
        lo, hi, p = min(NEAR, n - j), n - j, self.powers[j - i]
        step = 8
        while lo < hi:  # doubling first, as most extensions are short
            k = min(hi, lo + step) if step else (lo + hi + 1) >> 1
            if ((h[i + k] - h[i]) * p - h[j + k] + h[j]) & _MASK:
                hi, step = k - 1, 0
            else:
                lo, step = k, step * 2
        return self._verified(i, j, lo)

    def _verified(self, i: int, j: int, length: int) -> int:
        if length <= 64 and self.words[i : i + length] == self.words[j : j + length]:
            return length
        differ = np.flatnonzero(self.array[i : i + length] != self.array[j : j + length])
        return int(differ[0]) if len(differ) else length

    def _left(self, i: int, j: int) -> int:
        """How many words before ``i`` and ``j`` (i < j) are alike."""
        w, h = self.words, self.prefix
        for k in range(min(NEAR, i)):
            if w[i - 1 - k] != w[j - 1 - k]:
                return k
        lo, hi, p = min(NEAR, i), i, self.powers[j - i]
        step = 8
        while lo < hi:
            k = min(hi, lo + step) if step else (lo + hi + 1) >> 1
            if ((h[i] - h[i - k]) * p - h[j] + h[j - k]) & _MASK:
                hi, step = k - 1, 0
            else:
                lo, step = k, step * 2
        if lo <= 64 and w[i - lo : i] == w[j - lo : j]:
            return lo
        differ = np.flatnonzero(self.array[i - lo : i] != self.array[j - lo : j])
        return i - 1 - (i - lo + int(differ[-1])) if len(differ) else lo

    def around(self, i: int, j: int) -> tuple[int, int]:
        """The longest stretch [lo, hi) with lo <= i <= hi whose words equal those ``j - i`` further on."""
        d = j - i
        lo, hi = self.alike.get(d, (0, -1))
        if not lo <= i <= hi:
            lo, hi = self.alike[d] = i - self._left(i, j), i + self._right(i, j)
        return lo, hi

    def less(self, i: int, j: int, sign: int) -> bool:
        """Whether the suffix at ``i`` comes before that at ``j`` (i < j); ``sign`` -1 turns the order around."""
        if self.words[i] != self.words[j]:
            return (self.words[i] < self.words[j]) == (sign > 0)
        k = self.around(i, j)[1] - i
        if j + k >= self.n:
            return sign < 0  # the shorter suffix begins the longer one
        return (self.words[i + k] < self.words[j + k]) == (sign > 0)

    def runs(self, shortest: int, periods: int) -> set[tuple[int, int, int]]:
        """All runs (start, length, period) of ``shortest`` words and ``periods`` periods (2 or more) at least."""
        found, n, w, alike = set(), self.n, self.words, self.alike
        for sign in (1, -1):
            after = [0] * n  # the end of the longest Lyndon word from each place
            for i in range(n - 1, -1, -1):
                j = i + 1
                while j < n and self.less(i, j, sign):
                    j = after[j]
                after[i] = j
                if j < n and (w[i] == w[j] or i and w[i - 1] == w[j - 1]):
                    d = j - i
                    lo, hi = alike.get(d, (0, -1))
                    if not lo <= i <= hi:
                        lo, hi = self.around(i, j)
                    if (length := hi - lo + d) >= shortest and length >= periods * d:
                        found.add((lo, length, d))
            self.alike.clear()
        return found


def runs_of(numbers: np.ndarray, shortest: int = SHORTEST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of words given as numbers, by start, then period.

    A run of 4 periods and 6 words or more repeats each four words in a row that it holds; other words part the
    stretches to be scanned.
    """
    n = len(numbers)
    if n < shortest:
        return []
    parts = [(0, n)]
    if periods >= 4 and shortest >= 6:
        key = np.zeros(n - GRAM + 1, np.uint64)
        for k in range(GRAM):
            key = words.mix(key + numbers[k : n - GRAM + 1 + k].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(n, np.int64)  # starts of four words that come again, less their ends
        at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
        again[at] += 1
        ends = at + GRAM
        again[ends[ends < n]] -= 1
        held = np.concatenate([[0], np.cumsum(again) > 0, [0]]).astype(np.int8)
        edges = np.flatnonzero(np.diff(held))
        parts = [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= shortest]
    found = [(a + start, length, period) for a, b in parts for start, length, period in Stretch(numbers[a:b]).runs(shortest, periods)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(parts: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not runs:
        return parts
    change = np.zeros(len(parts) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [parts[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def find_runs(documents: DataFrame, *, text: str = "text", shortest: int = SHORTEST, periods: int = PERIODS) -> DataFrame:
    """Adds n_words, ``runs`` (start, length, period of each, by start, then period) and ``collapsed``, the words that no run holds behind its first period, joined by one space.

    A run is a stretch of at least ``shortest`` words and ``periods`` periods that no neighbouring word extends.  Words are
    parted by space and the control characters 9 to 13.  Null and empty texts have none; rows are judged one by one,
    so repeated rows, null ids and an empty table need no care.  All columns are carried along, but for names that are added, which are refused.
    """
    names = documents.columns
    if clash := set(ADDED.names) & {c.lower() for c in names}:
        raise ValueError(f"columns that the result adds exist already: {sorted(clash)}")
    out = T.StructType([*documents.schema.fields, *ADDED.fields])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in words.blocks(batches, text):
            columns = ([], [], [])
            for raw in texts:
                parts = raw.split()
                number: defaultdict[bytes, int] = defaultdict(count().__next__)
                found = runs_of(np.fromiter(map(number.__getitem__, parts), np.int64, len(parts)), shortest, periods)
                columns[0].append(len(parts))
                columns[1].append([dict(zip(RUN.names, r, strict=True)) for r in found])
                columns[2].append(b" ".join(collapsed(parts, found)))
            new = [pa.array(columns[0], pa.int64()), pa.array(columns[1], schema.field("runs").type), pa.array(columns[2], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new], schema=schema)

    return documents.mapInArrow(run, out)
