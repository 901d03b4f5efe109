"""Token ids as binary files of shuffled planes, and the job that writes and reads them.

A file holds ids end to end in chunks of a fixed number of ids.  A chunk's ids,
seen as a matrix of bytes (or of bits), are transposed so that bytes (bits) of
equal weight stand together, and each plane is compressed with zstandard; planes
above the chunk's largest id are left out.  Behind the chunks stand the documents'
ids and lengths and the chunk index, found through a footer of fixed size, so that
any span of ids is read by decompressing only the chunks that it touches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import shared, words

MAGIC = b"CLPLANE1"
CHUNK_IDS = 1 << 16
LEVEL = 1
_FOOTER = struct.Struct("<QQQ8s")


def shuffle(ids: np.ndarray, bits: bool = False) -> bytes:
    """One chunk: unsigned 32-bit ids as compressed planes, lowest weight first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        raw = np.unpackbits(raw, axis=1, bitorder="little")
    used = np.flatnonzero(raw.any(axis=0))
    planes = [np.ascontiguousarray(raw[:, k]) for k in range(int(used[-1]) + 1 if len(used) else 0)]
    packed = [zstandard.ZstdCompressor(level=LEVEL).compress((np.packbits(p, bitorder="little") if bits else p).tobytes()) for p in planes]
    return struct.pack(f"<IBB{len(packed)}I", len(ids), bits, len(packed), *map(len, packed)) + b"".join(packed)


def unshuffle(chunk: bytes | memoryview) -> np.ndarray:
    """The ids of one chunk."""
    n, bits, planes = struct.unpack_from("<IBB", chunk)
    sizes = struct.unpack_from(f"<{planes}I", chunk, 6)
    raw, at = np.zeros((n, 32 if bits else 4), np.uint8), 6 + 4 * planes
    for k, size in enumerate(sizes):
        plane = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(chunk[at : at + size])), np.uint8)
        raw[:, k] = np.unpackbits(plane, count=n, bitorder="little") if bits else plane
        at += size
    return (np.packbits(raw, axis=1, bitorder="little") if bits else raw).view("<u4").ravel()


def write_file(uri: str, documents: Iterator[tuple[int | None, np.ndarray]], bits: bool = False) -> tuple[int, int]:
    """Writes (document id, token ids) pairs in their order; returns the numbers of documents and ids."""
    names, lengths, index, held, n_held, at = [], [], [], [], 0, len(MAGIC)
    with shared.AtomicFile(uri) as out:
        out.write(MAGIC)

        def put(ids: np.ndarray) -> None:
            nonlocal at
            chunk = shuffle(ids, bits)
            index.append(at)
            out.write(chunk)
            at += len(chunk)

        for name, ids in documents:
            names.append(name)
            lengths.append(len(ids))
            held.append(ids)
            n_held += len(ids)
            if n_held >= CHUNK_IDS:
                rest = np.concatenate(held)
                while len(rest) >= CHUNK_IDS:
                    put(rest[:CHUNK_IDS])
                    rest = rest[CHUNK_IDS:]
                held, n_held = [rest], len(rest)
        if n_held:
            put(np.concatenate(held))
        missing = np.array([x is None for x in names], np.uint8)
        tables = [np.array([x or 0 for x in names], "<i8"), missing, np.array(lengths, "<u4" if max(lengths, default=0) < 1 << 32 else "<u8"), np.array(index, "<u8")]
        blob = zstandard.ZstdCompressor(level=LEVEL).compress(struct.pack("<QQB", len(names), len(index), tables[2].itemsize) + b"".join(x.tobytes() for x in tables))
        out.write(blob)
        out.write(_FOOTER.pack(at, len(blob), sum(lengths), MAGIC))
    return len(names), sum(lengths)


class Reader:
    """Reads a file of planes: all documents in order, or any span of ids."""

    def __init__(self, uri: str):
        self.data = memoryview(shared.map_file(uri))
        at, size, self.n_ids, magic = _FOOTER.unpack(self.data[-_FOOTER.size :])
        if magic != MAGIC or bytes(self.data[: len(MAGIC)]) != MAGIC:
            raise ValueError(f"{uri} is no file of planes")
        blob = zstandard.ZstdDecompressor().decompress(bytes(self.data[at : at + size]))
        n, chunks, wide = struct.unpack_from("<QQB", blob)
        place = 17
        self.names = np.frombuffer(blob, "<i8", n, place)
        self.missing = np.frombuffer(blob, np.uint8, n, place := place + 8 * n)
        self.lengths = np.frombuffer(blob, f"<u{wide}", n, place := place + n).astype(np.int64)
        self.index = np.append(np.frombuffer(blob, "<u8", chunks, place + wide * n).astype(np.int64), at)

    def span(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` on, before ``end``."""
        end = min(end, self.n_ids)
        if start >= end:
            return np.zeros(0, np.uint32)
        first = start // CHUNK_IDS
        parts = [unshuffle(self.data[self.index[k] : self.index[k + 1]]) for k in range(first, (end - 1) // CHUNK_IDS + 1)]
        return np.concatenate(parts)[start - first * CHUNK_IDS : end - first * CHUNK_IDS]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, place of its first id in the file, ids), chunk by chunk."""
        at, start, ids = 0, 0, np.zeros(0, np.uint32)
        for name, missing, n in zip(self.names.tolist(), self.missing, self.lengths.tolist(), strict=True):
            if at + n > start + len(ids):
                step = -(-(at + n - start - len(ids)) // CHUNK_IDS) * CHUNK_IDS
                ids = np.concatenate([ids[at - start :], self.span(start + len(ids), start + len(ids) + step)])
                start = at
            yield None if missing else name, at, ids[at - start : at - start + n]
            at += n


def _writer(folder: str, encoder: Callable[[], Callable[[list[bytes]], Iterator[np.ndarray]]], bits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(), TaskContext.get().partitionId()

        def documents():
            for batch, texts in words.blocks(batches):
                yield from zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True)

        n_docs, n_ids = write_file(uri := f"{folder}/part-{part:06d}.planes", documents(), bits)
        yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri], "n_docs": [n_docs], "n_ids": [n_ids]})

    return run


def write_tokens(documents: DataFrame, encoder: Callable[[], Callable[[list[bytes]], Iterator[np.ndarray]]], *, bits: bool = False) -> DataFrame:
    """Encodes ``documents`` in ascending doc_id order into files in the shared folder.

    Returns one row per file: part, uri, n_docs, n_ids and start, the number of
    ids in all files before it.  Rows are range-partitioned by doc_id and then by a
    hash of the text, so that not even a repeated doc_id gathers in one task.
    Null doc_ids come first; a null text is empty; an empty table gives files
    without documents.
    """
    spark = documents.sparkSession
    folder = shared.new_dir(spark, "planes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = documents.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    files = shared.save(
        keyed.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text").mapInArrow(_writer(folder, encoder, bits), "part long, uri string, n_docs long, n_ids long"),
        "manifest",
    )
    # One row for each file: the running sum over all of them is small whatever the input.
    starts, start = [], 0
    for part, n in sorted(files.select("part", "n_ids").toLocalIterator()):
        starts.append((part, start))
        start += n
    return files.join(F.broadcast(spark.createDataFrame(starts, "part long, start long")), "part")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for row in batch.to_pylist():
            rows = []
            for name, at, ids in Reader(row["uri"]).documents():
                rows.append((name, row["start"] + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                if len(rows) == 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)


def read_tokens(files: DataFrame) -> DataFrame:
    """Of each document in the files: doc_id, start (ids of all documents before it), n_tokens and the CRC-32 of its ids as little-endian 32-bit numbers."""
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartitionById(parts, (F.col("part") % parts).cast("int")).mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


#: The printable characters that stand for bytes in byte-level vocabularies: visible ones for themselves, the rest in order from 256.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARACTERS = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - _VISIBLE))}


#: Marks that, at a word's end, are one piece of their own for the pre-tokenizer; none that special strings end with.
_MARKS = b".,!?;:#$%&*+-=/@^_~()[]{}\"'`\\"
_AS_CHARACTERS = str.maketrans(_BYTE_CHARACTERS)


class _Kept(dict):
    """Packed ids by word; words that it lacks are asked for."""

    def __init__(self, ask: Callable[[bytes], bytes]):
        super().__init__()
        self.ask = ask

    def __missing__(self, word: bytes) -> bytes:
        return self.ask(word)


class WordEncoder:
    """Encodes texts with a tokenizer of the ``tokenizers`` library that never looks across white space.

    The library is asked once for each word; its answers are kept for the
    texts that follow, in two generations of a fixed number of words.
    """

    KEPT = 400_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.kept = _Kept(self._known)
        self.older: dict[bytes, bytes] = {}

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        base = word.rstrip(_MARKS)
        if 0 < len(base) < len(word):
            last = text[len(text) - len(word) + len(base) - 1]
            if last < "\u0250" and last.isalpha():
                # A letter and the marks behind it are always two pieces for the pre-tokenizer.
                return self.kept[base] + self.kept[word[len(base) :]]
        low = text.lower()
        if low.isalpha() and max(text) < "\u0250" and max(low) < "\u0250":
            # One piece, in normal form already: only the merges are left to do.
            plain = low if low.isascii() else low.encode().decode("latin-1").translate(_AS_CHARACTERS)
            ids = [x.id for x in self.merge(plain)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _known(self, word: bytes) -> bytes:
        """The ids of a word that was not used lately."""
        ids = self.older.get(word)
        if ids is None:
            ids = self._word(word)
        if len(self.kept) >= self.KEPT:
            self.older, self.kept = self.kept, _Kept(self._known)
        self.kept[word] = ids
        return ids

    def __call__(self, texts: list[bytes], end: int | None = None) -> Iterator[np.ndarray]:
        last = b"" if end is None else struct.pack("<I", end)
        for text in texts:
            # Letter case is lost anyway; only the special strings, if any, tell it apart.
            own = text.split() if b"<|" in text else text.translate(words.LOWER).split()
            yield np.frombuffer(b"".join(map(self.kept.__getitem__, own)) + last, "<u4")


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str, end: int | None = None) -> Callable[[], Callable[[list[bytes]], Iterator[np.ndarray]]]:
    """Makes, in a task, the worker's own encoder; it outlives the task and keeps its words until another operator's task comes."""

    def make():
        shared.let_go(_encoders)
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        return lambda texts: _encoders[path](texts, end)

    return make
