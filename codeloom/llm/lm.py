"""Language-model scoring with an Elias-Fano n-gram trie.

The trie's first level holds the words, its second the words seen after a word, its third
those seen after a word pair; all that the training texts hold is kept, each word by its exact number.
A word's number is its place among the sorted word codes of the first level.  Each level is
made of monotone sequences in Elias-Fano form: word codes and running sums of their counts;
pointers from a context to its successors; and successors made monotone by putting their context's
rank above their own number, so that a lookup is one successor search relative to its
context.  The third level's contexts are the places of the second level's pairs.

Probabilities are interpolated with absolute discounting.  They and the back-off weights are
quantised to one byte each, always downwards, so that no context's probabilities sum to more than 1,
and each level costs one quantisation step at most.

Training: tasks count words, and one task for each word shard merges them.  Tasks then count
pairs and triples and send them packed to the shard of the pair, so that the successors of a
common word are spread over all shards; one task for each shard merges them and writes a
file of two levels.  The number of shards follows the size of the texts, so a
shard's task stays of one size.  How many successors a word has, for its
back-off weight, is summed over the shards.  Scoring tasks map the files into memory, so
that only what their queries touch is read, and look up each distinct pair and triple of a
block once.
"""

from __future__ import annotations

import struct
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import shared, words

#: Codes of the end of a text, a token, and of its beginning, a context only.
END, BEGIN = np.uint64(0xE4D), np.uint64(0xBE6)
DISCOUNT = 0.75
#: Tokens that are handled at once: their distinct words have numbers of LOCAL bits.
SLICE, LOCAL = 2_000_000, np.uint64(21)
#: Bytes of training text for each shard of words, and of pairs and triples.
WORD_SHARD_BYTES, SHARD_BYTES = 128 << 20, 16 << 20
#: Bytes of trie files that a worker keeps mapped.
MAPPED_BYTES = 192 << 20


class EliasFano:
    """A monotone sequence of unsigned numbers, read in place from a buffer."""

    HEAD = struct.Struct("<QQQ")

    @staticmethod
    def build(values: np.ndarray) -> bytes:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(high[-1]) // 64 + 2 if n else 1) * 64, np.uint8)
        bits[high] = 1
        upper = np.packbits(bits, bitorder="little").view("<u8")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(upper), dtype=np.uint64)]).astype("<u8")
        zeros = np.arange(len(before), dtype="<i8") * 64 - before.astype("<i8")
        lows = values & np.uint64((1 << low) - 1)
        at = np.arange(n, dtype=np.uint64) * np.uint64(low)
        packed = np.zeros(n * low // 64 + 2, np.uint64)
        if low and n:
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(packed, word, lows << shift)
            over = shift + np.uint64(low) > 64
            np.bitwise_or.at(packed, word[over] + 1, lows[over] >> (np.uint64(64) - shift[over]))
        return EliasFano.HEAD.pack(n, low, len(upper)) + upper.tobytes() + before.tobytes() + zeros.tobytes() + packed.tobytes()

    def __init__(self, data, at: int = 0):
        self.n, low, size = self.HEAD.unpack_from(data, at)
        at += self.HEAD.size
        self.low = np.uint64(low)
        self.upper = np.frombuffer(data, "<u8", size, at)
        self.before = np.frombuffer(data, "<u8", size + 1, at := at + 8 * size)
        self.zeros = np.frombuffer(data, "<i8", size + 1, at := at + 8 * (size + 1))
        self.packed = np.frombuffer(data, "<u8", self.n * low // 64 + 2, at + 8 * (size + 1))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * self.low
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        first = self.packed[word] >> shift
        rest = np.where(shift > 0, self.packed[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (first | rest) & ((np.uint64(1) << self.low) - np.uint64(1))

    @staticmethod
    def _select_in_word(bits: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place of the k-th (from 0) one in each word."""
        place, k = np.zeros(len(bits), np.uint64), k.astype(np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            go = k >= count
            k = np.where(go, k - count, k)
            bits = np.where(go, bits >> np.uint64(width), bits)
            place += np.where(go, np.uint64(width), np.uint64(0))
        return place.astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.before, i.astype(np.uint64), side="right") - 1
        at = word * 64 + self._select_in_word(self.upper[word], i - self.before[word].astype(np.int64))
        return ((at - i).astype(np.uint64) << self.low) | self._lows(i)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th (from 0) zero: zeros before a word are its bits less its ones."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        return word * 64 + self._select_in_word(~self.upper[word], k - self.zeros[word])

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each value in ``x`` (of equal ones, the first), or -1."""
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        high, low = x >> self.low, x & ((np.uint64(1) << self.low) - np.uint64(1))
        ask = np.flatnonzero(high <= self.get(np.array([self.n - 1]))[0] >> self.low)
        h, low = high[ask].astype(np.int64), low[ask]
        # The values with high bits h lie between the zeros h - 1 and h: a binary search of their low bits.
        first = np.where(h > 0, self._zero(np.maximum(h - 1, 0)) + 1, 0) - h
        end = self._zero(h) - h
        stop = end.copy()
        live = np.flatnonzero(first < stop)
        while len(live):
            middle = (first[live] + stop[live]) >> 1
            less = self._lows(middle) < low[live]
            first[live[less]], stop[live[~less]] = middle[less] + 1, middle[~less]
            live = live[first[live] < stop[live]]
        same = first < end
        same[same] = self._lows(first[same]) == low[same]
        out[ask[same]] = first[same]
        return out


def quantise(p: np.ndarray, step: float) -> np.ndarray:
    """Probabilities as numbers of steps of log10 below 1, rounded down in probability."""
    return np.clip(np.ceil(-np.log10(np.maximum(p, 1e-300)) / step - 1e-9), 0, 255).astype(np.uint8)


def values(step: float) -> np.ndarray:
    """The probabilities that the bytes stand for."""
    return 10.0 ** -(np.arange(256) * step)


def pack(x: np.ndarray, *, ascending: bool = False) -> bytes:
    """Unsigned numbers as compressed byte planes; ascending ones by their differences."""
    x = np.asarray(x, np.uint64)
    if ascending:
        x = np.diff(x, prepend=np.uint64(0))
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, *, ascending: bool = False) -> np.ndarray:
    """Undoes ``pack``."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    x = out.view("<u8").ravel()
    return np.cumsum(x, dtype=np.uint64) if ascending else x


def _aligned(*parts: bytes) -> tuple[list[int], bytes]:
    """Where each part begins, and the parts on end, each on a multiple of 8."""
    padded = [x + bytes(-len(x) % 8) for x in parts]
    return [0, *np.cumsum([len(x) for x in padded])[:-1].tolist()], b"".join(padded)


def absent(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The distinct values of ``x`` that ``known`` lacks; both are sorted."""
    x = x[np.append(True, x[1:] != x[:-1])] if len(x) else x
    at = np.searchsorted(known, x)
    return x[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != x)] if len(known) else x


def _pieces(keys: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of equal keys below ``count``, in their order, for each key that occurs."""
    order = np.argsort(keys.astype(np.uint16) if count <= 1 << 16 else keys, kind="stable")
    cuts = np.searchsorted(keys[order], np.arange(count + 1, dtype=keys.dtype))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        yield k, order[cuts[k] : cuts[k + 1]]


class WordShard:
    """First level: the words whose codes leave one remainder, with their counts."""

    @staticmethod
    def build(codes: np.ndarray, counts: np.ndarray) -> bytes:
        at, data = _aligned(EliasFano.build(codes), EliasFano.build(np.concatenate([[0], np.cumsum(counts)])))
        return struct.pack("<2Q", *at) + data

    def __init__(self, data):
        self.codes, self.sums = (EliasFano(data, 16 + k) for k in struct.unpack_from("<2Q", data))

    def counts(self, places: np.ndarray) -> np.ndarray:
        return (self.sums.get(places + 1) - self.sums.get(places)).astype(np.int64)


class Shard:
    """Second and third level: the word pairs of one hash remainder, and the triples that begin with them."""

    HEAD = struct.Struct("<9Q")

    @staticmethod
    def build(contexts: np.ndarray, sizes: np.ndarray, pairs: np.ndarray, pair_codes: np.ndarray, triple_sizes: np.ndarray, triples: np.ndarray, triple_codes: np.ndarray, back: np.ndarray, width: int) -> bytes:
        """``pairs`` and ``triples`` are sorted: the rank of the context above ``width`` bits of the successor."""
        pointers = lambda n: EliasFano.build(np.concatenate([[0], np.cumsum(n)]))
        at, data = _aligned(EliasFano.build(contexts), pointers(sizes), EliasFano.build(pairs), pointers(triple_sizes), EliasFano.build(triples), pair_codes.tobytes(), back.tobytes(), triple_codes.tobytes())
        return Shard.HEAD.pack(width, *at) + data

    def __init__(self, data):
        width, *at = self.HEAD.unpack_from(data)
        self.width, at = np.uint64(width), [self.HEAD.size + k for k in at]
        self.contexts, self.pointers, self.pairs, self.triple_pointers, self.triples = (EliasFano(data, k) for k in at[:5])
        self.pair_codes, self.back = (np.frombuffer(data, np.uint8, self.pairs.n, k) for k in at[5:7])
        self.triple_codes = np.frombuffer(data, np.uint8, self.triples.n, at[7])

    def find_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair of word numbers, or -1; contexts that follow each other are looked up once."""
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        rank = self.contexts.find(a[new].astype(np.uint64))[np.cumsum(new) - 1]
        out, seen = np.full(len(a), -1, np.int64), np.flatnonzero(rank >= 0)
        out[seen] = self.pairs.find((rank[seen].astype(np.uint64) << self.width) | b[seen].astype(np.uint64))
        return out

    def find_triples(self, pairs: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The place of each triple, given the place of its pair, or -1."""
        return self.triples.find((pairs.astype(np.uint64) << self.width) | c.astype(np.uint64))

    def successors(self, pair: int) -> np.ndarray:
        """The numbers of the words seen after a pair."""
        first, end = self.triple_pointers.get(np.array([pair, pair + 1])).astype(np.int64)
        return self.triples.get(np.arange(first, end)) & ((np.uint64(1) << self.width) - np.uint64(1))


class Model:
    """Where the files lie, and the totals: what a task is sent."""

    def __init__(self, folder: str, first: list[int], n: int, v: int, shards: int):
        self.folder, self.first, self.n, self.v, self.shards = folder, np.array(first, np.int64), n, v, shards
        self.width = max(1, int(first[-1]).bit_length())
        #: Steps of log10 that a quantised value counts: the smallest one, a quarter of a count, is the last byte.
        self.step = float(np.log10(4 * max(n, 3))) / 254
        self.held: set[int] = set()

    def words(self, k: int) -> WordShard:
        return _map(f"{self.folder}/words-{k:06d}", WordShard)

    def back(self, k: int) -> np.ndarray:
        return _map(f"{self.folder}/back-{k:06d}", lambda data: np.frombuffer(data, np.uint8))

    def shard(self, k: int) -> Shard:
        return _map(f"{self.folder}/grams-{k:06d}", Shard)

    def shard_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return words.mix(words.mix(a.astype(np.uint64)) + b.astype(np.uint64)) % np.uint64(self.shards)

    def ask(self, codes: np.ndarray, *, back: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of word codes: numbers (-1 if unknown), counts and, if wanted, quantised back-off weights."""
        of = len(self.first) - 1
        number, count, weight = np.full(len(codes), -1, np.int64), np.zeros(len(codes), np.int64), np.zeros(len(codes), np.uint8)
        for k, at in _pieces(codes % np.uint64(of), of):
            if self.first[k] == self.first[k + 1]:
                continue
            shard = self.words(k)
            place = shard.codes.find(codes[at])
            at, place = at[place >= 0], place[place >= 0]
            number[at], count[at] = place + self.first[k], shard.counts(place)
            if back:
                weight[at] = self.back(k)[place]
        return number, count, weight

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of words by their numbers."""
        out = np.zeros(len(numbers), np.int64)
        of = np.searchsorted(self.first, numbers, side="right") - 1
        for k in np.unique(of).tolist():
            out[of == k] = self.words(k).counts(numbers[of == k] - self.first[k])
        return out

    def base(self, counts: np.ndarray) -> np.ndarray:
        """The smoothed probability of words by their counts alone."""
        return (counts + 0.5) / (self.n + 0.5 * (self.v + 1))


_mapped: OrderedDict[str, tuple[int, object]] = OrderedDict()


def _map(uri: str, reader):
    """A file's content by ``reader``; of those not used lately, only MAPPED_BYTES stay mapped."""
    shared.let_go(_mapped)
    if uri in _mapped:
        _mapped.move_to_end(uri)
    else:
        data = shared.map_file(uri)
        _mapped[uri] = len(data), reader(data)
        size = sum(n for n, _ in _mapped.values())
        while size > MAPPED_BYTES and len(_mapped) > 1:
            size -= _mapped.popitem(last=False)[1][0]
    return _mapped[uri][1]


def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts on end, each as BEGIN, the codes of its words and END; and the number of each text's tokens, END included."""
    flat, counts = words.codes([words.space_words(x) for x in texts])
    ends = np.cumsum(counts)
    out = np.empty(len(flat) + 2 * len(counts), np.uint64)
    inner = np.ones(len(out), bool)
    begins = ends - counts + 2 * np.arange(len(counts))
    out[begins], out[begins + counts + 1] = BEGIN, END
    inner[begins] = inner[begins + counts + 1] = False
    out[inner] = flat
    return out, counts + 1


def _slices(codes: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Parts of SLICE codes at most, each behind the two codes before it; and how many of these there are."""
    for i in range(0, len(codes), SLICE - 2):
        lead = min(2, i)
        yield codes[i - lead : i + SLICE - 2], lead


class Grams:
    """The tokens of a slice with their distinct words, and the keys of the pairs and triples that they end.

    Words have local numbers in the order of their numbers in the model (unknown ones first), so keys are in the
    order of the trie.
    """

    def __init__(self, model: Model, codes: np.ndarray, lead: int, *, back: bool = False):
        distinct, inverse = np.unique(codes, return_inverse=True)
        number, count, weight = model.ask(distinct, back=back)
        order = np.argsort(number, kind="stable")
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.arange(len(order), dtype=np.uint64)
        self.number, self.count, self.weight = number[order], count[order], weight[order]
        self.local = local = rank[inverse]
        begin = (distinct == BEGIN)[inverse]
        token = ~begin
        token[:lead] = False
        self.at = np.flatnonzero(token)
        self.pairs = (local[self.at - 1] << LOCAL) | local[self.at]
        #: Which of the tokens end a triple.
        self.third = np.flatnonzero(~begin[self.at - 1])
        two = self.at[self.third]
        self.triples = (local[two - 2] << (LOCAL + LOCAL)) | self.pairs[self.third]

    def word(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Local numbers of the k-th word from the end of each key."""
        return ((keys >> np.uint64(k * int(LOCAL))) & ((np.uint64(1) << LOCAL) - np.uint64(1))).astype(np.int64)


def _word_counter(shards: int):
    def packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        codes, n = np.unique(np.concatenate(held), return_counts=True)
        for k, at in _pieces(codes % np.uint64(shards), shards):
            yield pa.RecordBatch.from_pydict({"shard": pa.array([k], pa.int32()), "codes": [pack(codes[at], ascending=True)], "counts": [pack(n[at])]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, texts in words.blocks(batches):
            held.append(stream(texts)[0])
            size += len(held[-1])
            if size >= SLICE:
                yield from packed(held)
                held, size = [], 0
        if size:
            yield from packed(held)

    return run


def _word_merger(folder: str):
    def run(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = [], []
        for batch in rows:
            for r in batch.to_pylist():
                codes.append(unpack(r["codes"], ascending=True))
                counts.append(unpack(r["counts"]))
        codes, inverse = np.unique(np.concatenate(codes), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate(counts).astype(np.int64), len(codes)).astype(np.int64)
        shard = int(key[0].as_py())
        shared.write_file(f"{folder}/words-{shard:06d}", WordShard.build(codes, counts))
        begun = int(counts[codes == BEGIN].sum())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "v": [len(codes)], "n": [int(counts.sum()) - begun], "begun": [begun]})

    return run


#: Of a slice and shard, packed: contexts and how many pairs each begins; the pairs' words, counts and numbers of triples; the triples' words and counts.
GRAMS = ["contexts", "sizes", "pairs", "pair_counts", "triple_sizes", "triples", "triple_counts"]


def _gram_counter(model: Model):
    def packed(codes: np.ndarray, lead: int) -> Iterator[pa.RecordBatch]:
        own = Grams(model, codes, lead)
        pairs, pair_counts = np.unique(own.pairs, return_counts=True)
        triples, triple_counts = np.unique(own.triples, return_counts=True)
        a, b, c = (own.number[own.word(x, k)] for x, k in ((pairs, 1), (pairs, 0), (triples, 0)))
        # A pair across the slice's beginning was counted with the slice before; here it may stand for its triples alone.
        two = triples >> LOCAL
        missing = absent(two, pairs)
        if len(missing):
            pairs, where = np.unique(np.concatenate([pairs, missing]), return_index=True)
            pair_counts = np.concatenate([pair_counts, np.zeros(len(missing), np.int64)])[where]
            a, b = own.number[own.word(pairs, 1)], own.number[own.word(pairs, 0)]
        of = np.searchsorted(pairs, two)
        shard = model.shard_of(a, b)
        triples_at = dict(_pieces(shard[of], model.shards))
        sizes = np.bincount(of, minlength=len(pairs))
        for k, at in _pieces(shard, model.shards):
            contexts, n = np.unique(a[at], return_counts=True)
            t = triples_at.get(k, np.zeros(0, np.int64))
            row = [pack(contexts, ascending=True), *(pack(x) for x in (n, b[at], pair_counts[at], sizes[at], c[t], triple_counts[t]))]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x], pa.binary()) for x in row)], names=["shard", *GRAMS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, texts in words.blocks(batches):
            held.append(stream(texts)[0])
            size += len(held[-1])
            if size >= SLICE * 3 // 4:
                for part, lead in _slices(np.concatenate(held)):
                    yield from packed(part, lead)
                held, size = [], 0
        if size:
            for part, lead in _slices(np.concatenate(held)):
                yield from packed(part, lead)

    return run


def _ranked(contexts: np.ndarray, successors: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys (the context above ``width`` bits of the successor), the sums of their counts, and each row's key."""
    if int(contexts.max(initial=0)).bit_length() + width > 64:
        raise OverflowError("a shard holds too many contexts for the vocabulary: lower SHARD_BYTES")
    keys, inverse = np.unique((contexts.astype(np.uint64) << np.uint64(width)) | successors, return_inverse=True)
    return keys, np.bincount(inverse, counts, len(keys)).astype(np.int64), inverse


def _gram_merger(model: Model):
    def run(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = {x: [] for x in GRAMS}
        for batch in rows:
            for x in GRAMS:
                got[x] += [unpack(r, ascending=x == "contexts") for r in batch.column(x).to_pylist()]
        all_ = {x: np.concatenate(got.pop(x)).astype(np.int64) for x in GRAMS}
        width, low = model.width, (np.uint64(1) << np.uint64(model.width)) - np.uint64(1)
        contexts, rank = np.unique(all_["contexts"], return_inverse=True)
        pairs, pair_counts, of = _ranked(np.repeat(rank, all_["sizes"]), all_["pairs"].astype(np.uint64), all_["pair_counts"], width)
        triples, triple_counts, _ = _ranked(np.repeat(of, all_["triple_sizes"]), all_["triples"].astype(np.uint64), all_["triple_counts"], width)
        del all_, of
        of_pair, of_triple = (pairs >> np.uint64(width)).astype(np.int64), (triples >> np.uint64(width)).astype(np.int64)
        sizes, triple_sizes = np.bincount(of_pair, minlength=len(contexts)), np.bincount(of_triple, minlength=len(pairs))
        codes = [
            quantise((pair_counts - DISCOUNT) / model.counts(contexts)[of_pair], model.step),
            quantise((triple_counts - DISCOUNT) / pair_counts[of_triple], model.step),
            quantise(DISCOUNT * triple_sizes / pair_counts, model.step),
        ]
        shard = int(key[0].as_py())
        shared.write_file(f"{model.folder}/grams-{shard:06d}", Shard.build(contexts.astype(np.uint64), sizes, pairs, codes[0], triple_sizes, triples, codes[1], codes[2], width))
        for k, at in _pieces(np.searchsorted(model.first, contexts, side="right") - 1, len(model.first) - 1):
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "words": pa.array([k], pa.int32()), "places": [pack(contexts[at] - model.first[k], ascending=True)], "sizes": [pack(sizes[at])]})

    return run


def _back_writer(model: Model):
    def run(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = int(key[0].as_py())
        n = int(model.first[k + 1] - model.first[k])
        after = np.zeros(n, np.int64)
        for batch in rows:
            for places, sizes in zip(batch.column("places").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                after[unpack(places, ascending=True).astype(np.int64)] += unpack(sizes).astype(np.int64)
        back = quantise(DISCOUNT * after / model.words(k).counts(np.arange(n)), model.step)
        shared.write_file(f"{model.folder}/back-{k:06d}", back.tobytes())
        yield pa.RecordBatch.from_pydict({"words": pa.array([k], pa.int32())})

    return run


def train(texts: DataFrame, *, text: str = "text") -> Model:
    """Counts the words, pairs and triples of all ``texts`` (null: empty) and builds the trie's files."""
    spark = texts.sparkSession
    texts = texts.select(F.col(text).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    folder, word_shards = shared.new_dir(spark, "trie"), 1 + size // WORD_SHARD_BYTES
    counted = texts.mapInArrow(_word_counter(word_shards), "shard int, codes binary, counts binary").repartition(word_shards, "shard")
    built = counted.groupBy("shard").applyInArrow(_word_merger(folder), "shard int, v long, n long, begun long")
    rows = {r["shard"]: r for r in shared.save(built, "trie-words").collect()}  # one row for each shard
    first = np.cumsum([0, *(rows[k]["v"] if k in rows else 0 for k in range(word_shards))]).tolist()
    n, begun = (sum(r[x] for r in rows.values()) for x in ("n", "begun"))
    model = Model(folder, first, n, first[-1] - (begun > 0), 1 + size // SHARD_BYTES)
    counted = texts.mapInArrow(_gram_counter(model), "shard int, " + ", ".join(f"{x} binary" for x in GRAMS)).repartition(model.shards, "shard")
    built = shared.save(counted.groupBy("shard").applyInArrow(_gram_merger(model), "shard int, words int, places binary, sizes binary"), "trie-grams")
    model.held = {r["shard"] for r in built.select("shard").distinct().collect()}
    done = built.repartition(word_shards, "words").groupBy("words").applyInArrow(_back_writer(model), "words int")
    done.agg(F.count("*")).first()
    shared.forget(built)
    return model


def _pair_places(model: Model, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of word numbers: shard, place in it (-1 if not held), probability (0) and the weight of what lies below their successors (1)."""
    worth = values(model.step)
    of, place, p, back = model.shard_of(a, b), np.full(len(a), -1, np.int64), np.zeros(len(a)), np.ones(len(a))
    for k, at in _pieces(of, model.shards):
        if k in model.held:
            shard = model.shard(k)
            place[at] = found = shard.find_pairs(a[at], b[at])
            at, found = at[found >= 0], found[found >= 0]
            p[at], back[at] = worth[shard.pair_codes[found]], worth[shard.back[found]]
    return of, place, p, back


def _scored(model: Model, codes: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token of a slice: whether it is known, its base probability, and its probability."""
    worth, own = values(model.step), Grams(model, codes, lead, back=True)
    last, before = own.local[own.at].astype(np.int64), own.local[own.at - 1].astype(np.int64)
    base = model.base(own.count)[last]
    weight = np.where(own.number >= 0, worth[own.weight], 1.0)
    # The pair before the slice's first token may be one that no token of the slice ends.
    outer = own.triples[:1] >> LOCAL
    distinct, inverse = np.unique(np.concatenate([own.pairs, outer]), return_inverse=True)
    a, b = own.number[own.word(distinct, 1)], own.number[own.word(distinct, 0)]
    known = np.flatnonzero((a >= 0) & (b >= 0))
    of, place, p, back = np.zeros(len(a), np.uint64), np.full(len(a), -1, np.int64), np.zeros(len(a)), np.ones(len(a))
    of[known], place[known], p[known], back[known] = _pair_places(model, a[known], b[known])
    full = p[inverse[: len(base)]] + weight[before] * base
    # The pair that a triple begins with is the one that the token before ends.
    first = np.where(own.third > 0, inverse[own.third - 1], inverse[-1]) if len(own.third) else own.third
    asked = np.flatnonzero(place[first] >= 0)
    third, first = own.third[asked], first[asked]
    keys, inverse = np.unique(own.triples[asked], return_inverse=True)
    pair = np.zeros(len(keys), np.int64)
    pair[inverse] = first
    c, p = own.number[own.word(keys, 0)], np.zeros(len(keys))
    for k, at in _pieces(of[pair], model.shards):
        at = at[c[at] >= 0]
        shard = model.shard(k)
        found = shard.find_triples(place[pair[at]], c[at])
        p[at[found >= 0]] = worth[shard.triple_codes[found[found >= 0]]]
    full[third] = p[inverse] + back[first] * full[third]
    return own.number[last] >= 0, base, full


def score_block(model: Model, texts: list[bytes]) -> list[np.ndarray]:
    """Of each text: tokens, known tokens, base score and score."""
    codes, counts = stream(texts)
    known, base, full = (np.concatenate(x) for x in zip(*(_scored(model, part, lead) for part, lead in _slices(codes)), strict=True))
    starts = np.cumsum(counts) - counts
    sums = lambda x: np.add.reduceat(x, starts)
    return [counts, sums(known.astype(np.int64)), sums(np.log10(base)), sums(np.log10(full))]


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Scores all ``documents``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is the log10 probability of the text's words and end, each given the two
    words before it.  A null or empty text is its end alone.  Without training texts every token has
    the base probability 1 (no count, one unknown).  Repeated rows get equal scores; an empty table has none.
    """
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in words.blocks(batches, size=3 * words.BLOCK_BYTES):
            n, known, base, total = score_block(model, texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(texts), model.n), pa.int64()), pa.array(base), pa.array(total)], names=names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
