"""MinHash near-duplicates with odd sketches, confirmed on full shingle sets.

1. Each document becomes the set of its distinct word shingles, coded in 64 bits, a digest of
   that set, MinHash samples, and two odd sketches: bitmaps whose bits the samples flip, and
   whose bits the shingles themselves flip.
2. Documents of equal sets are one class.  Classes that agree in all samples of a band
   share a bucket; buckets of one class go.
3. In rounds, each bucket picks leaders, and every class of another component in the bucket
   is paired with them if the odd sketches (XOR, population count) leave the similarity
   possible: the samples' sketch estimates it for sets of any size, the shingles' never counts
   more than the sets differ by, and so settles most pairs of short texts.
   Pairs are confirmed on the full sets; confirmed links merge components.  A
   leader has then met its whole bucket and leaves it, and a bucket of one component is
   done.  Leaders double from round to round, so that any bucket ends after a logarithmic
   number of rounds, with every pair either met or already connected.

A group of copies is thus linked through its leaders, never through all its pairs,
and no bucket is ever gathered in one task: leaders come from an aggregation and meet
their bucket in a join, which adaptive execution splits where a bucket is hot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from codeloom.llm import shared, words

#: MinHash samples: BANDS times ROWS.  A pair of similarity 0.8 misses all bands in one of 3e7 cases, one of 0.85 in one of 2e10.
BANDS, ROWS = 32, 4
#: 64-bit words of an odd sketch.
ODD_WORDS = 8
#: Ids of at most so many rows are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000

_SEEDS = np.random.default_rng(97)
_FACTORS = _SEEDS.integers(0, 1 << 31, BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _SEEDS.integers(0, 1 << 32, BANDS * ROWS).astype(np.uint32)


def shingle_sets(docs: list[list[bytes]], size: int) -> list[np.ndarray]:
    """Sorted codes of the distinct ``size``-word shingles; of fewer words, the code of the whole; of none, nothing."""
    flat, counts = words.codes(docs)
    ends = np.cumsum(counts)
    h = np.zeros(max(0, len(flat) - size + 1), np.uint64)
    for k in range(size):
        h = words.mix(h + flat[k : k + len(h)])
    out = []
    for own, end, n in zip(docs, ends.tolist(), counts.tolist(), strict=True):
        if n >= size:
            out.append(np.unique(h[end - n : end - size + 1]))
        else:
            out.append(np.array([xxh3_64_intdigest(b" ".join(own), n)] if n else [], np.uint64))
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of samples for each set; none of the sets may be empty."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]])
    out = np.empty((len(_FACTORS), len(sets)), np.uint32)
    for k, (a, b) in enumerate(zip(_FACTORS, _TERMS, strict=True)):
        out[k] = np.minimum.reduceat(flat * a + b, starts)
    return out.T


def bands(samples: np.ndarray) -> np.ndarray:
    """A 64-bit code of each band, the band's number included."""
    table = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), table.shape[:2])
    for k in range(ROWS):
        h = words.mix(h * np.uint64(0x9E3779B97F4A7C15) + table[:, :, k])
    return h.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps: each sample, with its number, flips one bit."""
    bits = ODD_WORDS * 64
    at = words.mix(samples.astype(np.uint64) + (np.arange(samples.shape[1], dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    row = np.repeat(np.arange(len(samples)), samples.shape[1]) * bits
    parity = np.bincount(row + at.astype(np.int64).ravel(), minlength=len(samples) * bits) & 1
    return np.packbits(parity.astype(np.uint8).reshape(len(samples), bits), axis=1, bitorder="little").view(np.int64)


def set_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmaps: each shingle flips one bit, so two sketches differ in no more bits than their sets in shingles."""
    bits = ODD_WORDS * 64
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets]) * bits
    parity = np.bincount(row + (np.concatenate(sets) % np.uint64(bits)).astype(np.int64), minlength=len(sets) * bits) & 1
    return np.packbits(parity.astype(np.uint8).reshape(len(sets), bits), axis=1, bitorder="little").view(np.int64)


def most_flips(threshold: float) -> int:
    """XOR bits beyond which a pair of ``threshold`` similarity is ruled out: over six standard deviations away."""
    k, n = BANDS * ROWS, ODD_WORDS * 64
    differing = k * (1 - threshold) + 6.5 * math.sqrt(k * threshold * (1 - threshold))
    return math.ceil(n / 2 * (1 - math.exp(-4 * min(differing, k) / n)) + 3 * math.sqrt(n / 4))


def _sketcher(size: int, keep: Sequence[str] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.let_go()
        for batch, texts in words.blocks(batches):
            sets = shingle_sets([words.space_words(x) for x in texts], size)
            full = [k for k, x in enumerate(sets) if len(x)]
            band, odd = [None] * len(sets), [None] * len(sets)
            if full:
                samples = minhashes([sets[k] for k in full])
                for k, b, o in zip(full, bands(samples), np.hstack([odd_sketches(samples), set_sketches([sets[k] for k in full])]), strict=True):
                    band[k], odd[k] = b, o
            digest = [xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64())), *(batch.column(k) for k in keep)],
                names=["doc_id", "n_shingles", "digest", "bands", "odd", *keep],
            )

    return run


def _set_maker(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.let_go()
        for _, texts in words.blocks(batches):
            sets = [x for x in shingle_sets([words.space_words(x) for x in texts], size) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["digest", "shingles"])

    return run


def _few(df: DataFrame) -> DataFrame:
    """For the small side of a join: a broadcast where a count proves that it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) of the nodes of undirected ``edges`` (a, b); a component is named by its smallest node.

    Alternates large-star and small-star steps until the edges are stars.
    """
    now = shared.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "stars")
    n, sign = now.count(), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = shared.save(large, "stars", rows=2 * n)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = shared.save(small.select("e.u", "e.v").where("u != v").distinct(), "stars", rows=2 * n)
        shared.forget(now, large)
        now = after
        after = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == sign:
            break
        n, sign = after[0], after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _flips(a: str, b: str, first: int) -> Column:
    return sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(first, first + ODD_WORDS)), F.lit(0))


def _possible(a: str, b: str, percent: int) -> Column:
    """Whether the sketches of two sets leave a similarity of ``percent`` possible."""
    both = F.col(f"{a}n") + F.col(f"{b}n")
    return (_flips(a, b, 0) <= most_flips(percent / 100)) & ((100 + percent) * _flips(a, b, ODD_WORDS) <= (100 - percent) * both)


def _links(docs: DataFrame, sketched: DataFrame, size: int, percent: int) -> DataFrame:
    """Components (node, component) of the classes that have links, by the rounds that the module describes.

    ``sketched`` may hold a class more than once: a bucket that only repeats one class is closed at once.
    """
    odd = ["on", *(f"o{k}" for k in range(2 * ODD_WORDS))]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = sketched.select(F.explode("bands").alias("bucket"), "digest").repartition(parts, "bucket")
    several = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    live = shared.save(buckets.join(several.hint("shuffle_hash"), "bucket", "left_semi"), "buckets")
    n = live.count()
    nodes = live.select("digest").distinct()
    known = sketched.select("digest", "doc_id", F.col("n_shingles").alias("on"), *[F.col("odd")[k].alias(f"o{k}") for k in range(2 * ODD_WORDS)]).join(nodes.hint("shuffle_hash"), "digest", "left_semi")
    involved = shared.save(known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *[F.first(o).alias(o) for o in odd]), "involved")
    ids = _few(involved.select(F.col("doc_id").alias("id")).distinct())
    sets = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").mapInArrow(_set_maker(size), "digest binary, shingles array<long>")
    sets = shared.save(sets.join(_few(involved.select("digest")), "digest", "left_semi"), "sets")
    placed_nodes, links, leaders = involved.drop("doc_id").withColumn("component", F.col("digest")), None, 1
    components = involved.select(F.col("digest").alias("node"), F.col("digest").alias("component")).limit(0)
    while True:
        placed = live.join(placed_nodes, "digest")
        open_ = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("bucket")
        placed = placed.withColumn("slot", F.pmod(F.xxhash64("digest"), F.lit(leaders)))
        placed = shared.save(placed.join(open_, "bucket", "left_semi"), "placed", rows=n)
        n = placed.count()
        first = placed.groupBy("bucket", "slot").agg(F.min_by(F.struct("digest", "component", *odd), "digest").alias("l"))
        heads = first.select("bucket", F.col("l.digest").alias("leader"), F.col("l.component").alias("leads"), *[F.col(f"l.{o}").alias(f"l{o[1:]}") for o in odd])
        heads = shared.save(heads, "leaders", rows=n)
        if not n:
            if links is not None:  # without links the result reads ``involved``
                shared.forget(involved, sets)
            return components
        met = placed.join(heads, "bucket").where((F.col("component") != F.col("leads")) & _possible("o", "l", percent))
        pairs = shared.save(met.select(F.least("digest", "leader").alias("a"), F.greatest("digest", "leader").alias("b")).distinct(), "pairs")
        n_pairs = pairs.count()
        ends = _few(pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct())
        own = sets.join(ends, "digest", "left_semi")
        side = lambda k: own.select(F.col("digest").alias(k), F.col("shingles").alias(f"s{k}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
        real = both.where(100 * F.col("shared") >= percent * (F.size("sa") + F.size("sb") - F.col("shared"))).select("a", "b").distinct()
        real = shared.save(real, "links", rows=n_pairs, each=2_000)
        if not real.isEmpty():
            links = real if links is None else links.unionByName(real)
            components = shared.save(connected_components(links), "components", rows=2 * links.count())
            own = components.withColumnRenamed("node", "digest")
            placed_nodes = involved.drop("doc_id").join(own, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
        led = (F.col("bucket") == F.col("b")) & (F.col("digest") == F.col("leader"))
        left = placed.select("bucket", "digest").join(heads.select(F.col("bucket").alias("b"), "leader"), led, "left_anti")
        left = shared.save(left, "buckets", rows=n)
        shared.forget(live, placed, heads, pairs)
        live = left
        leaders *= 16


def near_duplicates(documents: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Components of near-duplicates: doc_id, n_shingles, component_id, kept.

    Two documents are linked if their sets of distinct ``shingle``-word shingles have a similarity
    of ``percent`` / 100 or more; component_id is the smallest doc_id reachable over links, and
    ``kept`` marks the row that bears it.  A text of fewer words is one shingle; null and empty
    texts and those without words have no set, no links, and their own id.  Rows that
    repeat a doc_id are linked by their texts like others; a null doc_id never names a component unless
    all its members lack one.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = shared.save(docs.mapInArrow(_sketcher(shingle), "doc_id long, n_shingles long, digest binary, bands array<long>, odd array<long>"), "sketches")
    named = _named(docs, sketched, shingle, percent).drop("component")
    full = sketched.where(F.col("digest").isNotNull())
    out = full.select("doc_id", "n_shingles", "digest").join(named, "digest").drop("digest")
    none = sketched.where(F.col("digest").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _named(docs: DataFrame, sketched: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows (digest, component, component_id) of all classes; a component is named by the digest of one of them."""
    full = sketched.where(F.col("digest").isNotNull())
    first = full.groupBy("digest").agg(F.min("doc_id").alias("first"))
    one = full.join(first, "digest").where(F.col("doc_id").eqNullSafe(F.col("first"))).drop("first")
    components = _links(docs, one, size, percent)
    named = first.join(components, first["digest"] == components["node"], "left").select("digest", F.coalesce("component", "digest").alias("component"), "first")
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return shared.save(named.join(smallest, "component").select("digest", "component", "component_id"), "named")


def keep_first(documents: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with its own columns, whatever their names: that of the smallest doc_id, nulls last.

    Rows are chosen, not ids: of rows that repeat an id, each stays or goes with the component of its
    own text.  Rows without words (null, empty or blank texts) have no component and all stay; an empty table
    stays empty; texts of any length count whole.
    """
    # Saved with numbers, so that a row keeps its number in all reads.
    number = shared.unused("row", documents.columns)
    rows = shared.save(documents.withColumn(number, F.monotonically_increasing_id()), "rows")
    docs = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(number).alias("row"))
    kinds = "doc_id long, n_shingles long, digest binary, bands array<long>, odd array<long>, row long"
    sketched = shared.save(docs.mapInArrow(_sketcher(shingle, ["row"]), kinds), "sketches")
    named = _named(docs, sketched, shingle, percent).select("digest", "component")
    own = shared.save(sketched.select("digest", "doc_id", "row").join(named, "digest"), "members")
    # Nulls sort first in structs: whether the id is lacking comes before it.
    stays = own.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row"))
    # Met by number, not by component, so that no task gets all rows of a large group.
    gone = own.join(stays, "row", "left_anti").select(F.col("row").alias(number))
    gone = shared.save(gone, "gone")
    shared.forget(sketched, named, own)
    return rows.join(_few(gone), number, "left_anti").drop(number)
