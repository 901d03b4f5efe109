"""Words of texts as byte strings and as 64-bit codes, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z; what is neither digit, letter nor part of a longer UTF-8 sequence becomes a space.
_ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Bytes of text that a block of rows holds at most, unless one row alone is longer.
BLOCK_BYTES = 4 << 20


def space_words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, split at space and the control characters 9 to 13."""
    return text.translate(LOWER).split()


def alnum_words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, runs of digits, letters and all that is not ASCII."""
    return text.translate(_ALNUM).split()


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as UTF-8 (null: empty), made one slice at a time."""
    for batch in batches:
        column = batch.column(text).cast(pa.binary())
        lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        cuts, held = [0], 0
        for i, n in enumerate(lengths):
            if held and held + n > size:
                cuts.append(i)
                held = 0
            held += n
        for start, end in zip(cuts, [*cuts[1:], len(lengths)], strict=True):
            if start < end:
                yield batch.slice(start, end - start), [x or b"" for x in column.slice(start, end - start).to_pylist()]


def codes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit codes of all documents' words on end, and the number of each document's words."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(counts.sum()))
    return flat, counts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
