"""Benchmark decontamination with suffix arrays over the training texts.

Documents are cut into shards.  In each, the words that occur in the test
items get numbers, all others 0, and the suffixes that can start a match (their
first two words stand side by side in some item) are sorted.  Every suffix of
every test item is then binary-searched in the shard; the range that it finds
gives the verbatim matches and their places, which are extended to full length.

The longest match at a place is found in the test side's own suffix array: the suffixes that
begin with a window are one range of it, and each further block of words narrows the range.

The test side is cut into chunks of bounded size, built by a task each, that lie as files in the
shared folder; a worker holds a few chunks at a time, so nothing here grows with the test
set but the number of passes over a shard in memory.  No document is shuffled.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.llm import shared, words

#: Words of a window.
WINDOW = 13
#: Bytes of test text in one chunk, about (an item alone may be longer).
CHUNK_BYTES = 4 << 20
#: Chunks that a worker holds.
HELD_CHUNKS = 2

FOUND = T.StructType([
    T.StructField("n_words", T.LongType(), False),
    T.StructField("n_hit", T.LongType(), False),
    T.StructField("n_items", T.LongType(), False),
    T.StructField("items", T.ArrayType(T.StringType()), False),
    T.StructField("items_sha256", T.StringType(), False),
    T.StructField("contaminated", T.BooleanType(), False),
    T.StructField("longest", T.LongType(), False),
    T.StructField("longest_at", T.LongType(), True),
    T.StructField("longest_item", T.StringType(), True),
])


class TestSide:
    """Test items as word numbers: what a task needs to search for them."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window, self.ids, self.names = window, {}, [item for item, _ in items]
        own = [words.alnum_words(text) for _, text in items]
        lengths = np.fromiter(map(len, own), np.int64, len(own))
        # Each item is closed by a 0, and so is the whole, for reads beyond its end.
        tokens = [k for x in own for k in (*(self.ids.setdefault(w, len(self.ids) + 1) for w in x), 0)]
        self.tokens = np.array([*tokens, *[0] * (window + 1)], np.int64)
        begins = np.cumsum(lengths + 1) - lengths - 1
        self.owner = np.repeat(np.arange(len(own)), lengths + 1)
        left = np.repeat(begins + lengths, lengths + 1) - np.arange(len(tokens))  # words from each place to its item's end
        at = np.flatnonzero((left >= window) | (np.isin(np.arange(len(tokens)), begins) & (left > 0)))
        sizes = np.minimum(left[at], window)
        # Windows of one size by their suffixes: equal windows are side by side.
        order = np.lexsort((self._suffix_ranks(int(lengths.max(initial=0)))[at], sizes))
        self.places, sizes = at[order], sizes[order]
        table = self._table(self.places, sizes, 0)
        new = np.ones(len(at), bool)
        new[1:] = (sizes[1:] != sizes[:-1]) | (table[1:] != table[:-1]).any(axis=1)
        self.first = np.flatnonzero(new)
        self.end = np.append(self.first[1:], len(at))
        self.starts, self.sizes = self.places[self.first], sizes[self.first]
        pairs = self.tokens[:-1] * (len(self.ids) + 1) + self.tokens[1:]
        self.pairs = np.unique(pairs[(self.tokens[:-1] > 0) & (self.tokens[1:] > 0)])
        self.singles = np.unique(self.tokens[self.starts[self.sizes == 1]])
        self.low, self.high = (as_keys(self._table(self.starts, self.sizes, fill)) for fill in (0, 0xFFFFFFFF))

    def _suffix_ranks(self, longest: int) -> np.ndarray:
        """The rank of each place among the suffixes, compared over twice ``longest`` words: twice as many words in each round.

        The ranks of the blocks of 1, 2, 4 ... words, up to ``longest``, are kept in ``blocks``, and the pairs of which each is made in ``made_of``.
        """
        rank, k = self.tokens, 1
        self.blocks, self.made_of = [self.tokens], []
        while k < 2 * longest:
            base = int(rank.max()) + 1
            after = np.concatenate([rank[k:], np.zeros(min(k, len(rank)), np.int64)])
            made_of, rank = np.unique(rank * base + after, return_inverse=True)
            k *= 2
            if k <= longest:
                self.blocks.append(rank.astype(np.int32))
                self.made_of.append((base, made_of))
        return rank

    def _table(self, places: np.ndarray, sizes: np.ndarray, fill: int) -> np.ndarray:
        """The words of windows, filled up to full length."""
        at = np.arange(self.window)
        return np.where(at < sizes[:, None], self.tokens[np.minimum(places[:, None] + at, len(self.tokens) - 1)], fill)

    def items(self, window: int) -> list[str]:
        """The items that hold a window."""
        return [self.names[k] for k in np.unique(self.owner[self.places[self.first[window] : self.end[window]]])]

    def known_blocks(self, ids: np.ndarray, where: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of the stretches of known words around the places ``where``: for 1, 2, 4 ... words, the places of blocks that some item holds, with their ranks."""
        stretch = np.cumsum(ids == 0)
        near = np.zeros(int(stretch[-1]) + 1, bool)
        near[stretch[where]] = True
        at = np.flatnonzero((ids > 0) & near[stretch])
        rank, out = ids[at], []
        for k in range(len(self.blocks)):
            if not len(at):
                break
            out.append((at, rank))
            if k < len(self.made_of):
                base, made_of = self.made_of[k]
                j = np.minimum(np.searchsorted(at, at + (1 << k)), len(at) - 1)
                pair = rank.astype(np.int64) * base + rank[j]
                new = np.minimum(np.searchsorted(made_of, pair), len(made_of) - 1)
                there = (at[j] == at + (1 << k)) & (made_of[new] == pair)
                at, rank = at[there], new[there]
        return out

    def extend(self, ids: np.ndarray, where: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of matches of window ``which`` at place ``where`` of ``ids``: the words of the longest match with any item, and the range of its suffixes.

        Each match grows by blocks of a power of two words, the longest first, so there are as many rounds as the longest item has binary digits.
        """
        length, lo, hi = self.sizes[which].copy(), self.first[which].copy(), self.end[which].copy()
        for k, (at, rank) in reversed(list(enumerate(self.known_blocks(ids, where)))):
            j = np.minimum(np.searchsorted(at, where + length), len(at) - 1)
            alive = np.flatnonzero(at[j] == where + length)
            block = rank[j[alive]]
            a = self._bound(lo[alive], hi[alive], length[alive], block, self.blocks[k])
            b = self._bound(a, hi[alive], length[alive], block + 1, self.blocks[k])
            alive, a, b = alive[a < b], a[a < b], b[a < b]
            length[alive] += 1 << k
            lo[alive], hi[alive] = a, b
        return length, lo, hi

    def _bound(self, lo: np.ndarray, hi: np.ndarray, length: np.ndarray, block: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """The first suffix in each range, all alike in ``length`` words, whose next block has the rank ``block`` or more."""
        lo, hi = lo.copy(), hi.copy()
        while (live := np.flatnonzero(lo < hi)).size:
            middle = (lo[live] + hi[live]) >> 1
            less = blocks[self.places[middle] + length[live]] < block[live]
            lo[live[less]], hi[live[~less]] = middle[less] + 1, middle[~less]
        return lo


def as_keys(table: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings in the same order."""
    return np.ascontiguousarray(table.astype(">u4")).view(f"S{4 * table.shape[1]}").ravel()


def suffix_array(ids: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The places ``at`` in the order of the suffixes that start there, to ``depth`` words, with those words as keys."""
    keys = as_keys(ids[at[:, None] + np.arange(depth)])
    order = np.argsort(keys, kind="stable")
    return at[order], keys[order]


def search(test: TestSide, docs: list[list[bytes]]) -> tuple[np.ndarray, list[set[str]], list[tuple[int, int, str | None]]]:
    """Of each document in the shard: which words are hit, the items found, and the longest match (words, place, item).

    Of longest matches the first counts, and of its items the one of the smallest name.
    The hit marks stand end to end, each document followed by ``window`` unused places.
    """
    w, found, best = test.window, [set() for _ in docs], [(0, -1, None)] * len(docs)
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    first = np.concatenate([[0], np.cumsum(sizes + w)])
    ids, get = np.zeros(int(first[-1]) + w, np.int64), test.ids.get
    for own, at in zip(docs, first, strict=False):
        ids[at : at + len(own)] = [get(x, 0) for x in own]
    change = np.zeros(len(ids) + 1, np.int64)
    starts = np.isin(ids[:-1] * (len(test.ids) + 1) + ids[1:], test.pairs) & (ids[:-1] > 0) & (ids[1:] > 0)
    if len(test.singles):
        starts |= np.isin(ids[:-1], test.singles)
    at = np.flatnonzero(starts[: int(first[-1])])
    if len(at) and len(test.starts):
        places, keys = suffix_array(ids, at, w)
        left, right = np.searchsorted(keys, test.low), np.searchsorted(keys, test.high, side="right")
        which = np.repeat(np.arange(len(left)), right - left)
        where = places[np.arange(len(which)) - np.repeat(np.cumsum(right - left) - (right - left), right - left) + np.repeat(left, right - left)]
        change += np.bincount(where, minlength=len(change)) - np.bincount(where + test.sizes[which], minlength=len(change))
        length, lo, hi = test.extend(ids, where, which)
        of = np.searchsorted(first, where, side="right") - 1
        single = test.end[which] - test.first[which] == 1
        for d, k in np.unique(np.stack([of[single], test.owner[test.starts[which[single]]]], 1), axis=0):
            found[d].add(test.names[k])
        for d, k in np.unique(np.stack([of[~single], which[~single]], 1), axis=0):
            found[d].update(test.items(k))
        at = where - first[of]
        order = np.lexsort((at, -length, of))
        for j in order[np.append(True, of[order][1:] != of[order][:-1])] if len(order) else order:
            owners = np.unique(test.owner[test.places[lo[j] : hi[j]]])
            best[of[j]] = (int(length[j]), int(at[j]), min(test.names[x] for x in owners))
    return np.cumsum(change[:-1]) > 0, found, best


_held: OrderedDict[str, TestSide] = OrderedDict()


def _chunk(uri: str) -> TestSide:
    """A chunk of the test side; a worker keeps the HELD_CHUNKS that it used last."""
    shared.let_go(_held)
    if uri not in _held:
        _held[uri] = pickle.loads(shared.read_file(uri))
        if len(_held) > HELD_CHUNKS:
            _held.popitem(last=False)
    _held.move_to_end(uri)
    return _held[uri]


def _scan(chunks: list[str], document_columns: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Larger shards where chunks must be read again for each.
        for batch, texts in words.blocks(batches, size=words.BLOCK_BYTES * (1 if len(chunks) <= HELD_CHUNKS else 4)):
            docs = [words.alnum_words(x) for x in texts]
            hits, items, best = None, [set() for _ in docs], [(0, -1, None)] * len(docs)
            for uri in chunks:
                hit, found, longest = search(_chunk(uri), docs)
                hits = hit if hits is None else hits | hit
                items = [a | b for a, b in zip(items, found, strict=True)]
                best = [min(a, b, key=lambda x: (-x[0], x[1], x[2] or "")) for a, b in zip(best, longest, strict=True)]
            n_words = [len(x) for x in docs]
            firsts = np.cumsum([0, *(n + WINDOW for n in n_words)])
            n_hit = [int(hits[a : a + n].sum()) if hits is not None else 0 for a, n in zip(firsts, n_words, strict=False)]
            names = [sorted(x) for x in items]
            out = [
                n_words, n_hit, [len(x) for x in names], names,
                [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names],
                [h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words, strict=True)],
                [x[0] for x in best], [x[1] if x[0] else None for x in best], [x[2] for x in best],
            ]
            kept = [batch.column(c) for c in document_columns]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, schema.field(len(kept) + i).type) for i, v in enumerate(out))], schema=schema)

    return run


def chunked(benchmark: DataFrame, item: str, text: str, window: int) -> list[str]:
    """Test items as files of bounded size in the shared folder, built by a task each; unlike items are dealt by their hash."""
    spark = benchmark.sparkSession
    folder = shared.new_dir(spark, "testside")
    # Rows that repeat find nothing more.
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = 1 + size // CHUNK_BYTES
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("item", "text"), F.lit(chunks)).cast("int"))

    def build(key: tuple, own: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sorted((r["item"], r["text"].encode()) for batch in own for r in batch.to_pylist())
        shared.write_file(uri := f"{folder}/{key[0].as_py():06d}", pickle.dumps(TestSide(items, window)))
        yield pa.RecordBatch.from_pydict({"uri": [uri]})

    return sorted(r["uri"] for r in rows.repartition(chunks, "chunk").groupBy("chunk").applyInArrow(build, "uri string").collect())  # one row a chunk


def find_contamination(documents: DataFrame, benchmark: DataFrame, *, keep: list[str] | None = None, item: str = "item_id", text: str = "text") -> DataFrame:
    """Adds to each row of ``documents`` what of ``benchmark`` it holds verbatim.

    A window is WINDOW consecutive item words; a shorter item, if it has words, is
    one window.  ``n_hit`` counts the document's words inside occurrences,
    ``items`` the items with windows that occur, ``longest`` the words of the
    longest match with its place and item.  Null and empty texts have no words;
    null item ids count as the empty name; rows that repeat are each judged; an
    empty test set hits nothing, and an empty table stays empty.  ``keep`` names the columns to carry along (all);
    of names that both inputs have, only the documents' own are meant.
    """
    keep = documents.columns if keep is None else keep
    added = [f for f in FOUND.fields if f.name not in keep]
    if len(added) < len(FOUND.fields):
        raise ValueError(f"columns that the result adds exist already: {sorted(set(keep) & set(FOUND.names))}")
    chunks = chunked(benchmark, item, text, WINDOW)
    inner = documents.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])])
    out = T.StructType([*(documents.schema[c] for c in keep), *FOUND.fields])
    return inner.mapInArrow(_scan(chunks, keep, to_arrow_schema(out)), out)


def remove_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns, whatever their names.

    Null and empty texts stay; rows that repeat share one fate; an empty table stays empty; an empty
    test set removes nothing.
    """
    renamed, back = shared.aside(documents, FOUND.names)
    found = find_contamination(renamed, benchmark)
    return found.where(~F.col("contaminated")).drop(*FOUND.names).withColumnsRenamed(back)
