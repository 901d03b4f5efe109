"""SentencePiece encoding and decoding by streaming Viterbi.

The lattice of a text has a node at each boundary between characters and an edge for each
piece.  Characters come in one by one; of all edges that end at the new boundary one
survives.  Only nodes closer than the longest piece can be extended, so once the
backpointer paths of all of these meet in one boundary, the ids before it are final: they are
committed and forgotten.

Which edge survives depends on the model.  For a unigram model it is the one of the best
total score.  A merge (BPE) model has another optimum: its encoding is the one path whose
neighbouring pieces would all withstand the merges, and each prefix has just one such path.  So there an
edge survives if the piece before it and its own piece, merged as a text of their own, stay as they are.

A boundary between two characters that stand side by side in no piece is crossed by no edge; texts are
cut there, and the ids of the stretches between are kept for when they recur.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.llm import shared, words

SPACE = "▁"
#: Stretches of text whose ids are kept, in each of two generations, and pairs of pieces known to withstand merging or not.
KEPT, KEPT_PAIRS = 300_000, 2_000_000


class Pieces:
    """The pieces of a model: those that text is made of, the byte pieces, and the unknown piece."""

    def __init__(self, normal: list[tuple[str, int, float]], byte_ids: dict[int, int], unknown: int, *, merges: bool, dummy_prefix: bool = True, trim: bool = False, names: dict[int, str] | None = None):
        self.ids = {p: k for p, k, _ in normal}
        self.scores = {p: s for p, _, s in normal}
        self.bytes, self.unknown, self.merges, self.dummy_prefix, self.trim = byte_ids, unknown, merges, dummy_prefix, trim
        self.longest = max(map(len, self.ids), default=1)
        self.penalty = min(self.scores.values(), default=0.0) - 10.0
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.text = {k: p.replace(SPACE, " ").encode() for p, k, _ in normal} | {k: bytes([b]) for b, k in byte_ids.items()}
        self.text[unknown] = " ⁇ ".encode()
        for k, name in (names or {}).items():
            self.text.setdefault(k, name.encode())
        self.pairs: dict[tuple[str, str], bool] = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Reads a model file whose normaliser changes nothing but white space."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.precompiled_charsmap or not model.normalizer_spec.escape_whitespaces:
            raise ValueError("only models whose normaliser is the identity are supported")
        kinds = model.SentencePiece
        normal = [(p.piece, k, p.score) for k, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
        byte_ids = {int(p.piece[3:-1], 16): k for k, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        unknown = next(k for k, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        controls = {k: "" for k, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        kind = model.trainer_spec.model_type
        if kind not in (model.trainer_spec.UNIGRAM, model.trainer_spec.BPE):
            raise ValueError("only unigram and merge models are supported")
        return cls(normal, byte_ids if model.trainer_spec.byte_fallback else {}, unknown, merges=kind == model.trainer_spec.BPE, dummy_prefix=model.normalizer_spec.add_dummy_prefix, trim=model.normalizer_spec.remove_extra_whitespaces, names=controls)

    def normalise(self, text: str) -> str:
        if self.trim:
            text = " ".join(x for x in text.split(" ") if x)
        return (" " if self.dummy_prefix and text else "").__add__(text).replace(" ", SPACE)

    def withstand(self, a: str, b: str) -> bool:
        """Whether the merges leave ``a`` and ``b``, side by side, as two pieces."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return known

    def merged(self, text: str) -> list[str]:
        """A short text after all merges, best score first and leftmost of equals."""
        own = list(text)
        while True:
            best, at = None, -1
            for i in range(len(own) - 1):
                s = self.scores.get(own[i] + own[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return own
            own[at : at + 2] = [own[at] + own[at + 1]]

    def output(self, piece: str) -> list[int]:
        """The ids of a piece, or of a character that is none."""
        k = self.ids.get(piece)
        if k is not None:
            return [k]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]


class Stream:
    """Streaming Viterbi over one text that arrives in parts."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.text = ""  # what is not committed; node k lies before its k-th character
        self.back = [0]  # the node before
        self.score = [0.0]
        self.widest = 0  # nodes ever held at once, beyond those that can still be extended

    def _survivor(self, end: int) -> tuple[int, float]:
        """The node before and the score of the edge that survives at node ``end``."""
        p, text, best = self.pieces, self.text, None
        if p.merges:
            # At most one edge can survive; short pieces are the likelier ones.
            ids, back, pairs = p.ids, self.back, p.pairs
            for start in range(end - 1, max(0, end - p.longest) - 1, -1):
                piece = text[start:end]
                if piece in ids or start == end - 1:
                    if not start:  # a committed boundary, which no piece or merge crosses
                        return 0, 0.0
                    before = text[back[start] : start]
                    known = pairs.get((before, piece))
                    if known or known is None and p.withstand(before, piece):
                        return start, 0.0
        else:
            for start in range(max(0, end - p.longest), end):
                s = p.scores.get(text[start:end], p.penalty if end - start == 1 else None)
                if s is not None and (best is None or self.score[start] + s > best[1]):
                    best = start, self.score[start] + s
        return best

    def feed(self, text: str) -> list[int]:
        """Takes more text; returns the ids that became final."""
        out = []
        for c in text:
            self.text += c
            before, score = self._survivor(len(self.back))
            self.back.append(before)
            self.score.append(score)
            if len(self.back) > 2 * self.pieces.longest:
                out += self._commit(self._meeting())
        return out

    def finish(self) -> list[int]:
        """The ids of the rest."""
        out = self._commit(len(self.back) - 1)
        return out

    def _meeting(self) -> int:
        """The last boundary that the paths of all extendable nodes share."""
        live = set(range(max(0, len(self.back) - self.pieces.longest), len(self.back)))
        self.widest = max(self.widest, len(self.back) - len(live))
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(self.back[last])
        return live.pop()

    def _commit(self, node: int) -> list[int]:
        # With merges the piece before the cut stays, since the next one must withstand merging with it.
        cut = self.back[node] if self.pieces.merges and node < len(self.back) - 1 else node
        ends, k = [], cut
        while k:
            ends.append(k)
            k = self.back[k]
        out, at = [], 0
        for k in reversed(ends):
            out += self.pieces.output(self.text[at:k])
            at = k
        self.text = self.text[cut:]
        self.back = [max(0, b - cut) for b in self.back[cut:]]
        lead = self.score[cut]
        self.score = [s - lead for s in self.score[cut:]]
        return out


class Codec:
    """Encodes and decodes whole texts; ids of stretches that recur are kept."""

    def __init__(self, path: str | Pieces):
        self.pieces = path if isinstance(path, Pieces) else Pieces.load(path)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = max(self.pieces.text) + 1
        self.table = [self.pieces.text.get(k, b"") for k in range(self.size)]
        inside = self.pieces.inside
        # Cuts between any character and a space, and around line feeds, if no piece holds such neighbours.
        self.coarse = not any(x[1] == SPACE and x[0] != SPACE for x in inside) and not any("\n" in p for p in self.pieces.ids)
        self.stretches = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")

    def _known(self, text: str, whole: bool = False) -> bytes:
        ids = self.kept.get(text) or self.older.get(text)
        if ids is None:
            inside, cut, out = self.pieces.inside, 0, []
            cuts = [] if whole else [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in inside]
            if cuts:
                for i in [*cuts, len(text)]:
                    out.append(self._known(text[cut:i], True))
                    cut = i
                ids = b"".join(out)
            else:
                stream = Stream(self.pieces)
                ids = np.array(stream.feed(text) + stream.finish(), "<u4").tobytes()
        if len(text) <= 64:
            if len(self.kept) >= KEPT:
                self.kept, self.older = {}, self.kept
            self.kept[text] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        text = self.pieces.normalise(text)
        own = self.stretches.findall(text) if self.coarse else [text] if text else []
        got = list(map(self.kept.get, own))
        if None in got:
            got = [self._known(x) if ids is None else ids for x, ids in zip(own, got, strict=True)]
        return np.frombuffer(b"".join(got), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 are replaced."""
        raw = b"".join(map(self.table.__getitem__, ids.tolist()))
        if self.pieces.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode(errors="replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's own codec, which outlives the task and keeps what it knows until another operator's task comes."""
    shared.let_go(_codecs)
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(documents: DataFrame, path: str, *, keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids``, the model's ids of each whole text, of any length; null texts have none."""
    keep = documents.columns if keep is None else keep
    if "ids" in keep:
        raise ValueError("columns that the result adds exist already: ['ids']")
    out = T.StructType([*(documents.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch, texts in words.blocks(batches):
            ids = pa.array([own.encode(x.decode()).astype(np.int32) for x in texts], schema.field("ids").type)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), ids], schema=schema)

    return documents.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])]).mapInArrow(run, out)


def decode(encoded: DataFrame, path: str, *, keep: list[str] | None = None) -> DataFrame:
    """Adds ``decoded``, the text of each row's ``ids`` (null: empty); a column of that name is refused."""
    keep = encoded.columns if keep is None else keep
    if "decoded" in keep:
        raise ValueError("columns that the result adds exist already: ['decoded']")
    out = T.StructType([*(encoded.schema[c] for c in keep), T.StructField("decoded", T.StringType(), False)])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], schema=schema)

    return encoded.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "ids"])]).mapInArrow(run, out)


def digests(documents: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes each whole text: doc_id, n_ids, ids_crc32 (as little-endian 32-bit numbers), decoded_crc32 (UTF-8) and same.

    ``same``: the decoded text equals the text, but for the model's space mark in place of
    spaces.  Null and empty texts have no ids.  Repeated rows get equal results.
    """
    names = ["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "same"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch, texts in words.blocks(batches):
            rows = []
            for x in texts:
                text = x.decode()
                ids = own.encode(text)
                again = own.decode(ids)
                rows.append((len(ids), zlib.crc32(ids.tobytes()), zlib.crc32(again.encode()), again == text.replace(SPACE, " ")))
            columns = zip(*rows, strict=True)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, same boolean")
