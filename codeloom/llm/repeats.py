"""Removal of passages that earlier documents hold, by super-k-mers.

A window is WINDOW consecutive words.  Its minimiser is the least of its runs of GRAM words, in an order
that puts frequent runs last and is random otherwise; consecutive windows of one minimiser form a super-k-mer,
whose words travel as one packed string to the bucket of that minimiser.  Equal windows have equal
minimisers, so a bucket holds all occurrences of its windows; there the windows are sorted,
which groups equal ones exactly, and each learns the smallest id that it occurs under.

No bucket grows with one frequent passage.  Windows at the edge of such a passage hold words of their
document too, whose runs are rarer and hence come first in the order.  Windows inside of it are the same in all
documents: a task settles what repeats in its own block of texts and sends on each distinct string once, for the
smallest id; a bucket keeps one entry for each distinct string.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh3_64_intdigest

from codeloom.llm import shared, words

#: Words of a window and of the runs that its minimiser is chosen from.
WINDOW, GRAM = 13, 3
#: Bytes of packed strings in a bucket, on average.
BUCKET_BYTES = 24 << 20
#: A run of words is frequent if it makes up this share of all, and is counted in blocks where it comes this often.
#: So at most 1 / FREQUENT runs are known as frequent, whatever the corpus; which are decides how even buckets are, not results.
FREQUENT, IN_BLOCK = 1e-5, 3

_MULTIPLIERS = words.mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
#: What ``remove_repeats`` adds.
ADDED = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType())]
_SPANS = T.StructType([T.StructField("id", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def folded(codes: np.ndarray, n: int) -> np.ndarray:
    """Of each place, one number of the ``n`` codes that start there, as far as so many are left."""
    m = max(0, len(codes) - n + 1)
    out, product = np.zeros(m, np.uint64), np.empty(m, np.uint64)
    for k in range(n):
        np.multiply(codes[k : k + m], _MULTIPLIERS[k % 64], out=product)
        out += product
    return words.mix(out)


def least_of(values: np.ndarray, n: int) -> np.ndarray:
    """Of each place, the least of the ``n`` values that start there."""
    if len(values) < n:
        return values[:0]
    out, have = values, 1
    while have < n:
        step = min(have, n - have)
        out, have = np.minimum(out[: len(out) - step], out[step:]), have + step
    return out


class Block:
    """Texts of a task as words on end: ``flat``, their codes, and where each document's words begin and end."""

    def __init__(self, texts: list[bytes]):
        split = [x.split() for x in texts]
        self.flat = list(chain.from_iterable(split))
        self.codes = np.fromiter(map(xxh3_64_intdigest, self.flat), np.uint64, len(self.flat))
        self.ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(texts)), self.ends - self.begins)

    def grams(self, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """The number of each run of ``gram`` words, and whether it lies in one document."""
        grams = folded(self.codes, gram)
        return grams, np.arange(len(grams)) + gram <= self.ends[self.owner[: len(grams)]]

    def super_kmers(self, window: int, gram: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, word behind the last, and minimiser of each stretch of windows of one minimiser."""
        grams, _ = self.grams(gram)
        top = np.uint64(1 << 63)
        order = (words.mix(grams) >> np.uint64(1)) | np.where(np.isin(grams, frequent), top, np.uint64(0))
        least = least_of(order, window - gram + 1)
        if not len(least):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(np.arange(len(least)) + window <= self.ends[self.owner[: len(least)]])
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (least[at[1:]] != least[at[:-1]]) | (self.owner[at[1:]] != self.owner[at[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        return at[first], at[last] + window, least[at[first]]


def _frequent(documents: DataFrame, gram: int) -> tuple[np.ndarray, int]:
    """The frequent runs of words (at most 1 / FREQUENT), and the bytes of all texts."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in words.blocks(batches):
            block = Block(texts)
            grams, whole = block.grams(gram)
            values, counts = np.unique(grams[whole], return_counts=True)
            often = counts >= IN_BLOCK
            n = int(often.sum())
            size, total = sum(map(len, texts)), int(whole.sum())
            yield pa.RecordBatch.from_arrays([pa.array([*values[often].view(np.int64), None], pa.int64()), pa.array([*counts[often], total], pa.int64()), pa.array([0] * n + [size], pa.int64())], names=["gram", "n", "size"])

    sums = shared.save(documents.select("text").mapInArrow(tally, "gram long, n long, size long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("size").alias("size")), "grams")
    total = sums.where("gram IS NULL").first()
    if total is None:
        return np.zeros(0, np.uint64), 0
    # Each makes up FREQUENT of all, so there are 1 / FREQUENT at most.
    found = sums.where(F.col("gram").isNotNull() & (F.col("n") >= max(2, int(total["n"] * FREQUENT)))).select("gram").toArrow()
    shared.forget(sums)
    return np.sort(found["gram"].to_numpy().astype(np.int64)).view(np.uint64), total["size"]


def _packed(strings: list[bytes], per_string: np.ndarray, doc: np.ndarray, start: np.ndarray, ids: np.ndarray, hashes: np.ndarray, spans: np.ndarray) -> bytes:
    """Distinct strings, the places (document, first word) of each, and spans (document, start, end) settled already."""
    used, own = np.unique(np.concatenate([doc, spans[0]]), return_inverse=True)
    text = b"\n".join(strings)
    head = struct.pack("<5I", len(strings), len(doc), len(used), spans.shape[1], len(text))
    parts = [per_string.astype("<u4"), own[: len(doc)].astype("<u4"), start.astype("<u4"), own[len(doc) :].astype("<u4"), spans[1].astype("<u4"), spans[2].astype("<u4"), ids[used].astype("<i8"), hashes[used].astype("<i8")]
    return zstandard.compress(head + text + b"".join(p.tobytes() for p in parts), 3)


def _unpacked(blob: bytes) -> tuple:
    data = zstandard.decompress(blob)
    n, m, docs, spans, size = struct.unpack_from("<5I", data)
    at = 20 + size
    out = [data[20:at].split(b"\n") if n else []]
    for k, kind in ((n, "<u4"), (m, "<u4"), (m, "<u4"), (spans, "<u4"), (spans, "<u4"), (spans, "<u4"), (docs, "<i8"), (docs, "<i8")):
        out.append(np.frombuffer(data, kind, k, at).astype(np.int64))
        at += k * (8 if kind == "<i8" else 4)
    return tuple(out)


def _sender(window: int, gram: int, frequent: np.ndarray, buckets: int):
    """Packs the super-k-mers of blocks of (id, hash, text) rows for their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in words.blocks(batches):
            known = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column("id").fill_null(0).to_numpy()
            hashes = batch.column("hash").to_numpy()
            # Rows without an id have no part in it, and of rows alike in id and text one speaks for all.
            seen = {(i, h): k for k, (i, h) in reversed(list(enumerate(zip(ids.tolist(), hashes.tolist(), strict=True)))) if known[k]}
            block = Block([t if known[k] and seen[ids[k], hashes[k]] == k else b"" for k, t in enumerate(texts)])
            first, end, least = block.super_kmers(window, gram, frequent)
            if not len(first):
                continue
            doc = block.owner[first]
            start, stop = first - block.begins[doc], end - block.begins[doc]
            strings = pa.array([b" ".join(block.flat[a:b]) for a, b in zip(first.tolist(), end.tolist(), strict=True)], pa.large_binary()).dictionary_encode()
            kind, strings = strings.indices.to_numpy(), strings.dictionary.to_pylist()
            order = np.lexsort((ids[doc], kind))
            smallest = np.zeros(len(strings), np.int64)
            smallest[kind[order[::-1]]] = ids[doc[order[::-1]]]  # the last that is put counts, the smallest id
            mine = ids[doc] == smallest[kind]
            # Strings that a smaller id of the block has too are settled here; documents' spans follow each other, with rising ends.
            row, lo, hi = doc[~mine], start[~mine], stop[~mine]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (lo[1:] > hi[:-1])
            at = np.flatnonzero(new)
            settled = np.stack([row[at], lo[at], hi[np.append(at[1:], len(row)) - 1] if len(at) else at])
            bucket = (words.mix(least * _MULTIPLIERS[0]) % np.uint64(buckets)).astype(np.int64)
            left = np.flatnonzero(mine)
            left = left[np.lexsort((start[left], doc[left], kind[left], bucket[left]))]
            cuts = np.flatnonzero(np.diff(bucket[left], prepend=-1))
            none, spare = np.zeros((3, 0), np.int64), int(hashes[0]) % buckets
            out = ([], [])
            for a, b in zip(cuts, np.append(cuts[1:], len(left)), strict=True):
                part = left[a:b]
                own, per = np.unique(kind[part], return_counts=True)
                out[0].append(int(bucket[part[0]]))
                out[1].append(_packed([strings[k] for k in own], per, doc[part], start[part], ids, hashes, none))
            if settled.size:
                out[0].append(spare)
                out[1].append(_packed([], none[0], none[0], none[0], ids, hashes, settled))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["bucket", "blob"])

    return run


def first_owners(strings: list[bytes], owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of packed strings that a string of a smaller owner holds, as stretches of words: string, first word, word behind the last.

    The windows are sorted by a number of their words; neighbours of one number are compared word by word,
    and if any differ, all are sorted by their words instead.
    """
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes = np.fromiter((s.count(b" ") + 1 for s in strings), np.int64, len(strings))
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(s.split(b" ") for s in strings)), np.int64, int(sizes.sum()))
    many = sizes - window + 1
    of = np.repeat(np.arange(len(strings)), many)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    at = np.repeat(np.cumsum(sizes) - sizes, many) + inside
    key = folded(words.mix(ids.astype(np.uint64) + np.uint64(1)), window)[at]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not all(np.array_equal(ids[at[order[same]] + k], ids[at[order[same + 1]] + k]) for k in range(window)):
        order = np.lexsort([ids[at + k] for k in reversed(range(window))])
        equal = np.ones(len(order) - 1, bool)
        for k in range(window):
            equal &= ids[at[order[1:]] + k] == ids[at[order[:-1]] + k]
        same = np.flatnonzero(equal)
    new = np.ones(len(order), bool)
    new[same + 1] = False
    group = np.cumsum(new) - 1
    smallest = np.minimum.reduceat(owner[of[order]], np.flatnonzero(new)) if len(order) else owner[:0]
    hit = np.zeros(len(of), bool)
    hit[order] = owner[of[order]] > smallest[group]
    at = np.flatnonzero(hit)
    cut = np.ones(len(at), bool)
    cut[1:] = (np.diff(at) > 1) | (of[at[1:]] != of[at[:-1]])
    a = np.flatnonzero(cut)
    b = np.append(a[1:], len(at)) - 1 if len(a) else a
    return of[at[a]], inside[at[a]], inside[at[b]] + window


def _settler(window: int):
    """Spans of words (id, hash, start, end) to remove, of one bucket."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, list[tuple[int, int]]]] = {}  # of each string: its smallest id, and there the texts' hashes and first words
        out: list[tuple[int, int, int, int]] = []

        def drain() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ((),) * 4
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["id", "hash", "start", "end"])
            out.clear()
            return batch

        def settle(string: bytes, owner: int, places: list[tuple[int, int]]) -> None:
            n = string.count(b" ") + 1
            out.extend([(owner, h, start, start + n) for h, start in set(places)])

        for batch in batches:
            for blob in batch.column("blob"):
                strings, per, doc, start, row, lo, hi, ids, hashes = _unpacked(blob.as_py())
                out.extend(zip(ids[row].tolist(), hashes[row].tolist(), lo.tolist(), hi.tolist(), strict=True))
                owners, at = ids[doc].tolist(), 0
                places = list(zip(hashes[doc].tolist(), start.tolist(), strict=True))
                for s, n in zip(strings, per.tolist(), strict=True):
                    own, mine = owners[at], places[at : at + n]
                    at += n
                    if (old := held.get(s)) is None or own < old[0]:
                        held[s] = own, mine
                        if old:
                            settle(s, *old)
                    elif own == old[0]:
                        held[s] = own, list({*old[1], *mine})
                    else:
                        settle(s, own, mine)
                if len(out) > 100_000:
                    yield drain()
        if held:
            strings, owners = list(held), np.fromiter((x[0] for x in held.values()), np.int64, len(held))
            for s, a, b in zip(*(x.tolist() for x in first_owners(strings, owners, window)), strict=True):
                own, places = held[strings[s]]
                out.extend((own, h, start + a, start + b) for h, start in places)
                if len(out) > 100_000:
                    yield drain()
        yield drain()

    return run


def repeated_spans(documents: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Spans of words (id, hash, start, end) of (id, hash, text) rows that lie in windows which start in a row of a smaller id."""
    spark = documents.sparkSession
    frequent, size = _frequent(documents, gram)
    # Of each window - gram + 2 words or so, window - 1 travel twice.
    bytes_ = size * (1 + 2 * (window - 1) / (window - gram + 2))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(bytes_ // BUCKET_BYTES) + 1)
    sent = documents.mapInArrow(_sender(window, gram, frequent, buckets), "bucket int, blob binary")
    return sent.groupBy("bucket").applyInArrow(_settler(window), _SPANS)


def _keeper(schema: pa.Schema, columns: list[str]):
    """Words of ``__text`` outside of ``__spans``, beside the columns that are carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in words.blocks(batches, "__text"):
            kept, n_words, n_removed = [], [], []
            for text, own in zip(texts, batch.column("__spans").to_pylist(), strict=True):
                parts = text.split()
                n_words.append(len(parts))
                if own:
                    change = np.zeros(len(parts) + 1, np.int64)
                    np.add.at(change, [s["start"] for s in own], 1)
                    np.add.at(change, [s["end"] for s in own], -1)
                    parts = [parts[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                n_removed.append(n_words[-1] - len(parts))
                kept.append(b" ".join(parts))
            new = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *new], schema=schema)

    return run


def remove_repeats(documents: DataFrame, *, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Adds n_words, n_removed and ``kept``: the words, joined by one space, outside of windows that a document of a smaller id holds too.

    Windows are judged on the input, not on what is left.  Null and empty texts have no words; texts shorter than
    a window keep all.  A row of a null id neither loses words nor takes any from others.  Rows that repeat an id take
    nothing from each other, as no id is smaller than itself; each is judged by its own text (told apart by 64-bit hashes).  All
    columns are carried along, whatever their names, but for the three that are added, which are refused; an empty table stays empty.
    """
    names = documents.columns
    if clash := {n for n, *_ in ADDED} & {c.lower() for c in names}:
        raise ValueError(f"columns that the result adds exist already: {sorted(clash)}")
    key, value = F.col(f"`{id}`").cast("long"), F.col(f"`{text}`").cast("string")
    spans = repeated_spans(documents.select(key.alias("id"), F.xxhash64(value).alias("hash"), value.alias("text")), window=window)
    spans = spans.groupBy(F.col("id").alias("__id"), F.col("hash").alias("__hash")).agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    # All columns as one, so that no name can clash.
    rows = documents.select(key.alias("__id"), F.xxhash64(value).alias("__hash"), value.alias("__text"), F.struct(*[F.col(f"`{c}`") for c in names if c != text], F.lit(0)).alias("__row"))
    both = rows.join(spans, ["__id", "__hash"], "left").select("__row", "__text", "__spans")
    out = T.StructType([both.schema["__row"], both.schema["__text"], *(T.StructField(n, kind) for n, kind in ADDED)])
    kept = both.mapInArrow(_keeper(to_arrow_schema(out), ["__row", "__text"]), out)
    return kept.select(*[F.col("__text").alias(c) if c == text else F.col("__row").getField(c).alias(c) for c in names], *[n for n, _ in ADDED])
