"""Toxicity by multiple-instance learning: labels of documents, scores of sentences.

A sentence's probability is a logistic function of its words' weights; a
document is toxic unless none of its sentences, nor a small leak, makes it so (noisy-or).
Only documents carry labels; the gradient of the noisy-or hands the blame to the
sentences that can explain them, and those are reported with their places.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh3_64_intdigest

from codeloom.llm import shared, words

#: Labelled documents to learn from at most, and their characters in all.
TRAIN_DOCUMENTS = 16_000
TRAIN_CHARS = 64_000_000
#: Bits of the feature table; bytes of the word beginnings that are features beside the word.
BITS = 20
PREFIXES = (4, 5, 6)
EPOCHS = 14
#: Share of words hidden in each pass, lest one word of a sentence speak for the others.
HIDDEN = 0.3
#: Pull of each weight towards 0.
PENALTY = 1e-3
#: Documents of the sample that a feature must occur in.
MIN_DOCUMENTS = 3

_SENTENCES = bytes(10 if chr(c) in ".!?\n" else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_BREAKS = re.compile(r"[.!?\n]")


def sentences(text: bytes) -> list[list[bytes]]:
    """Distinct words of each sentence, in lower case; sentences without words stand for themselves, so numbers agree with the text's."""
    return [list(dict.fromkeys(x.split())) for x in text.decode().lower().encode().translate(_SENTENCES).split(b"\n")]


def features(word: bytes) -> list[int]:
    mask = (1 << BITS) - 1
    return [xxh3_64_intdigest(word) & mask, *(xxh3_64_intdigest(word[:n], n) & mask for n in PREFIXES if len(word) >= n)]


class Model:
    """Feature weights, the bias of a sentence and the leak."""

    def __init__(self, weights: np.ndarray, bias: float, leak: float):
        self.weights, self.bias, self.leak = weights, bias, leak

    def scorer(self):
        """A function from a text to its score and the sentences (number, score) of probability 0.5 or more."""
        weights, bias, clean = self.weights, self.bias, math.log1p(-self.leak)

        class Kept(dict):
            def __missing__(self, word):
                out = self[word] = float(weights[features(word)].sum())
                return out

        kept = Kept()
        get = kept.__getitem__

        def score(text: bytes) -> tuple[float, list[tuple[int, float]]]:
            if len(kept) > 400_000:
                kept.clear()
            none, bad = clean, []
            for k, own in enumerate(sentences(text)):
                if own:
                    z = bias + sum(map(get, own))
                    none -= math.log1p(math.exp(z)) if z < 30 else z
                    if z >= 0:
                        bad.append((k, 1 / (1 + math.exp(-min(z, 700)))))
            return -math.expm1(none), bad

        return score


def train(rows: Iterator[tuple[int, bytes]]) -> Model:
    """Fits the noisy-or to (label, text) pairs by mini-batch AdaGrad."""
    numbers: dict[bytes, int] = {}
    docs, labels = [], []
    for label, text in rows:
        own = [x for x in sentences(text) if x]
        docs.append((np.fromiter((numbers.setdefault(w, len(numbers)) for s in own for w in s), np.int32), np.fromiter(map(len, own), np.int32)))
        labels.append(label)
    n, size = len(docs), 1 << BITS
    weights, bias, leak = np.zeros(size + 1, np.float32), -5.0, math.log(1e-4)
    if not n or not numbers:
        rate = (sum(labels) + 0.5) / (n + 1) if n else 1e-3
        return Model(weights[:size], bias, min(rate, 0.4))
    # Features of each word, filled up with an unused one; those of few documents are unused too.
    table = np.full((len(numbers), 1 + len(PREFIXES)), size, np.int32)
    for word, k in numbers.items():
        own = features(word)
        table[k, : len(own)] = own
    seen = np.zeros(size + 1, np.int32)
    for own, _ in docs:
        seen[np.unique(table[np.unique(own)])] += 1
    seen[size] = 0
    used_features = np.flatnonzero(seen >= MIN_DOCUMENTS)
    place = np.full(size + 1, len(used_features), np.int32)
    place[used_features] = np.arange(len(used_features))
    table, size = place[table], len(used_features)
    weights = np.zeros(size + 1, np.float32)
    y = np.array(labels, np.float64)
    squares, square_b, square_l = np.full(size + 1, 1e-2), 1e-2, 1e-2
    order = np.random.default_rng(5)
    for epoch in range(EPOCHS):
        for batch in np.array_split(order.permutation(n), max(1, n // 64)):
            flat = np.concatenate([docs[i][0] for i in batch])
            lengths = np.concatenate([docs[i][1] for i in batch])
            counts = np.array([len(docs[i][1]) for i in batch])
            used = table[flat]
            used[order.random(len(flat)) < HIDDEN] = size
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            z = bias + (np.add.reduceat(weights[used].sum(1, dtype=np.float64), starts) if len(flat) else np.zeros(0))
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            of = np.repeat(np.arange(len(batch)), counts)
            none = np.bincount(of, np.logaddexp(0, z), len(batch)) - math.log1p(-math.exp(leak))
            toxic = np.maximum(-np.expm1(-none), 1e-12)
            blame = np.where(y[batch] > 0, (1 - toxic) / toxic, -1.0)
            g = p * blame[of]
            grad = np.bincount(used.ravel(), np.repeat(np.repeat(g, lengths), used.shape[1]), size + 1) / len(batch) ** 0.5
            squares += grad * grad
            rate = 0.5 / (1 + epoch) ** 0.5
            weights = (weights + rate * (grad - PENALTY * weights) / np.sqrt(squares)).astype(np.float32)
            weights[size] = 0
            gb = g.sum() / len(batch) ** 0.5
            square_b += gb * gb
            bias = min(-4.0, bias + rate * gb / math.sqrt(square_b))
            if epoch < EPOCHS // 2:
                continue  # the words first: a leak that grows early would explain everything
            gl = (blame * math.exp(leak) / (1 - math.exp(leak))).sum() / len(batch) ** 0.5
            square_l += gl * gl
            leak = min(math.log(0.05), max(-12.0, leak + rate * gl / math.sqrt(square_l)))
    whole = np.zeros(1 << BITS, np.float32)
    whole[used_features] = weights[:size]
    return Model(whole, bias, math.exp(leak))


def sample(documents: DataFrame, labels: DataFrame, label: str, limit: int, chars: int | None = None) -> DataFrame:
    """At most ``limit`` labelled documents as (label, text), chosen by a hash of their ids.

    Of several labels of one document the largest counts; rows without a label, id or
    text are left out.  ``chars`` bounds the characters in all: the documents are taken in the order of their hashes,
    and one that would exceed it is passed over.
    """
    chosen = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")).dropna().groupBy("id").agg(F.max("label").alias("label"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("id"), "id").limit(limit))  # at most ``limit`` rows
    rows = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    own = F.col("doc_id") == F.col("id")
    if chars is None:
        return rows.join(chosen, own).select("label", "text")
    sizes = rows.join(chosen, own).groupBy("id").agg(F.sum(F.length("text")).alias("size"), F.max("label").alias("label"))
    within, left = [], chars
    for r in sizes.orderBy(F.xxhash64("id"), "id").collect():  # at most ``limit`` rows of three numbers
        if r["size"] <= left:
            within.append((r["id"], r["label"]))
            left -= r["size"]
    within = F.broadcast(documents.sparkSession.createDataFrame(within, sizes.select("id", "label").schema))
    return rows.join(within, own).select("label", "text")


def learn(documents: DataFrame, labels: DataFrame, *, label: str = "toxic", limit: int = TRAIN_DOCUMENTS, chars: int = TRAIN_CHARS) -> Model:
    """Learns from a bounded sample of labelled documents: ``limit`` of them and ``chars`` characters in all at most.

    Without labels, or with texts that hold no word, the rate of toxic ones alone is learnt.
    """
    rows = sample(documents, labels, label, limit, chars)
    return train((r["label"], r["text"].encode()) for r in rows.toLocalIterator())


OFFENDING = T.ArrayType(T.StructType([T.StructField("sentence", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def places(text: str, bad: list[tuple[int, float]]) -> list[dict]:
    cuts = [-1, *(m.start() for m in _BREAKS.finditer(text)), len(text)]
    return [{"sentence": k, "start": cuts[k] + 1, "length": cuts[k + 1] - cuts[k] - 1, "score": p} for k, p in bad]


def score(documents: DataFrame, model: Model, *, keep: list[str] | None = None) -> DataFrame:
    """Adds ``score`` (probability of toxic), ``predicted`` (score of 0.5 or more) and ``offending`` (sentences of probability 0.5 or more).

    Whole texts count, of any length.  Null and empty texts, and those without words, get
    the leak as their score.  Repeated rows get equal scores.  Columns of the documents
    that bear an added name must be left out of ``keep``.
    """
    keep = documents.columns if keep is None else keep
    added = [T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False), T.StructField("offending", OFFENDING, False)]
    if clash := {f.name for f in added} & set(keep):
        raise ValueError(f"columns that the result adds exist already: {sorted(clash)}")
    out = T.StructType([*(documents.schema[c] for c in keep), *added])
    schema = to_arrow_schema(out)
    sent = documents.sparkSession.sparkContext.broadcast(model)  # of fixed size: 2 ** BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.let_go()
        scorer = sent.value.scorer()
        for batch, texts in words.blocks(batches):
            got = [scorer(x) for x in texts]
            kept = [batch.column(c) for c in keep]
            new = [[s for s, _ in got], [int(s >= 0.5) for s, _ in got], [places(x.decode(), bad) if bad else [] for x, (_, bad) in zip(texts, got, strict=True)]]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, schema.field(len(kept) + i).type) for i, v in enumerate(new))], schema=schema)

    return documents.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])]).mapInArrow(run, out)


def remove_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns, whatever their names.

    Null and empty texts have the leak as their score and stay unless the leak is 0.5 or more; rows that
    repeat share one fate; an empty table stays empty.
    """
    names = ["score", "predicted", "offending"]
    renamed, back = shared.aside(documents, names)
    return score(renamed, model).where(F.col("predicted") == 0).drop(*names).withColumnsRenamed(back)
