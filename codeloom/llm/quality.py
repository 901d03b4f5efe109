"""Quality by a document classifier and hierarchical empirical Bayes over sites.

The classifier is a logistic regression on the text's shape (letter case, marks,
repetition, word lengths) and on its words, counted in hashed buckets.  A document's source
names sites on several levels: its host, and the paths below it, segment by segment.  Labels
counted by site give posteriors: a path's rate is shrunk towards that of the path above, a
host's towards the global rate, each by a strength that the spread between the level's
sites decides, so that sparse sites say little.  The evidence is combined as log-odds: the
classifier's, plus what the deepest site's posterior departs from the global rate.  A
labelled document's own label is left out of the counts that it is judged by.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.llm import shared, words
from codeloom.llm.toxicity import sample

#: Labelled documents to fit the classifier on at most.
TRAIN_DOCUMENTS = 16_000
#: Buckets that words are hashed into.
BUCKETS = 128
#: Pull of each weight towards 0.
PENALTY = 2.0
#: Levels of sites: the host and so many path segments less one.
LEVELS = 3
#: Strength of a prior, in labels: at least, and at most.
WEAKEST, STRONGEST = 20.0, 10_000.0
#: Sites that are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST_SITES = 200_000

_CLASSES = {
    "upper": bytes(range(65, 91)),
    "digit": bytes(range(48, 58)),
    "stop": b".,;:",
    "mark": b"!?",
    "bar": b"|",
    "sign": b"#$%&*+/<=>@\\^_`{}~",
    "line": b"\n",
    "bracket": b"()[]\"'-",
}
SHAPE = [*_CLASSES, "words", "distinct", "same_as_before", "word_length", "long_words", "empty"]
FEATURES = [*SHAPE, *(f"bucket{k}" for k in range(BUCKETS))]


def features(text: bytes) -> list[float]:
    """The shape of a text and the shares of its words by bucket, as numbers between 0 and about 1."""
    n = max(1, len(text))
    own = text.split()
    m = max(1, len(own))
    same = sum(map(bytes.__eq__, own, own[1:]))
    letters = n - m
    return [
        *((len(text) - len(text.translate(None, x))) / n for x in _CLASSES.values()),
        math.log1p(m) / 10, len(set(own)) / m, same / m, min(letters / m, 30) / 10, sum(len(w) > 20 for w in own) / m, float(not own),
        *(np.bincount(np.fromiter(map(zlib.crc32, text.translate(words.LOWER).split()), np.int64) % BUCKETS, minlength=BUCKETS) / m).tolist(),
    ]


class Model:
    """Logistic regression on standardised features: the shape's with their square roots and squares, the buckets' square roots."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray):
        self.mean, self.spread, self.weights = mean, spread, weights

    @staticmethod
    def _expand(x: np.ndarray) -> np.ndarray:
        shape = x[:, : len(SHAPE)]
        return np.concatenate([np.sqrt(x), shape, shape * shape], axis=1)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Model:
        """Newton's method with a small penalty; without both labels, the smoothed rate alone."""
        width = len(FEATURES) + 2 * len(SHAPE)
        if len(y) == 0 or y.min() == y.max():
            rate = (y.sum() + 0.5) / (len(y) + 1)
            return cls(np.zeros(width), np.ones(width), np.append(np.zeros(width), math.log(rate / (1 - rate))))
        x = cls._expand(x)
        mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = np.append((x - mean) / spread, np.ones((len(x), 1)), axis=1)
        w, pull = np.zeros(width + 1), np.append(np.full(width, PENALTY), 1e-6)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hess = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(pull)
            step = np.linalg.solve(hess, z.T @ (y - p) - pull * w)
            w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, spread, w)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((self._expand(x) - self.mean) / self.spread, -20, 20)
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -15, 15)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shared.let_go()
    for batch, texts in words.blocks(batches):
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([features(x) for x in texts], pa.list_(pa.float64()))], names=["label", "x"])


def learn(documents: DataFrame, labels: DataFrame, *, label: str = "quality", limit: int = TRAIN_DOCUMENTS) -> Model:
    """Fits the classifier to a bounded sample of labelled documents, whose features alone reach the driver.

    Whole texts count, of any length; rows without id, text or label are not learnt from.
    """
    rows = sample(documents, labels, label, limit).mapInArrow(_features, "label int, x array<double>").collect()
    return Model.fit(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([float(r["label"] > 0) for r in rows]))


def sites(source: Column) -> Column:
    """The sites of a source from the host down, LEVELS at most: ``host``, ``host/a``, ``host/a/b``; a null source is the empty host."""
    bare = F.regexp_replace(F.coalesce(source.cast("string"), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    parts = F.split(F.regexp_replace(bare, "[?#].*", ""), "/")
    named = F.concat(F.array(F.lower(parts[0])), F.filter(F.slice(parts, 2, LEVELS - 1), lambda x: x != ""))
    return F.transform(F.sequence(F.lit(1), F.size(named)), lambda n: F.array_join(F.slice(named, F.lit(1), n), "/"))


def _labels(labels: DataFrame, label: str) -> DataFrame:
    """id and label (0 or 1) of each labelled id; of several labels the largest counts."""
    own = labels.select(F.col("doc_id").alias("id"), (F.col(label).cast("int") > 0).cast("long").alias("label"))
    return own.dropna().groupBy("id").agg(F.max("label").alias("label"))


def _strength(rates: DataFrame) -> float:
    """Labels that a prior counts for, by the method of moments on the n, good and prior (mean) of one level's sites."""
    r = rates.where("n > 0").agg(
        F.count("*").alias("k"),
        F.sum(F.pow(F.col("good") - F.col("n") * F.col("prior"), 2) / F.col("n")).alias("chi"), F.sum(F.col("prior") * (1 - F.col("prior"))).alias("noise"),
        F.sum(F.col("n") * F.col("prior") * (1 - F.col("prior"))).alias("scale"),
    ).first()
    if not r["k"] or not r["scale"] or r["chi"] <= r["noise"]:
        return STRONGEST
    between = (r["chi"] - r["noise"]) / r["scale"]
    return min(STRONGEST, max(WEAKEST, 1 / between - 1)) if between < 1 else WEAKEST


class Sites:
    """Labels counted by site: a table (level, site, n, good, prior, rate), their totals, and each level's strength."""

    def __init__(self, table: DataFrame, n: int, good: int, strengths: list[float]):
        self.table, self.n, self.good, self.strengths = table, n, good, strengths


def site_posteriors(documents: DataFrame, labels: DataFrame, *, label: str = "quality") -> Sites:
    """The posteriors of all sites with labels, by grouped aggregation; ``prior`` is the posterior of the site above.

    Counts cover all labelled documents, each row of a repeated id by itself; null ids have no labels.
    """
    source = F.col("source") if "source" in documents.columns else F.lit(None).cast("string")
    rows = documents.select(F.col("doc_id").alias("id"), sites(source).alias("sites")).join(_labels(labels, label), "id")
    counted = rows.select("label", F.posexplode("sites").alias("level", "site")).groupBy("level", "site").agg(F.count("*").alias("n"), F.sum("label").alias("good"))
    counted = shared.save(counted, "sites")  # all that follows reads these counts
    n, good = counted.where("level = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    done, above, strengths = [], None, []
    for level in range(LEVELS):
        own = counted.where(F.col("level") == level)
        if above is None:
            own = own.withColumn("prior", F.lit((good + 0.5) / (n + 1)))
        else:
            own = own.withColumn("parent", F.regexp_replace("site", "/[^/]*$", "")).join(above.select(F.col("site").alias("parent"), F.col("rate").alias("prior")), "parent").drop("parent")
        strengths.append(k := _strength(own))
        above = own.withColumn("rate", (F.col("good") + k * F.col("prior")) / (F.col("n") + k))
        done.append(above.select("level", "site", "n", "good", "prior", "rate"))
    return Sites(shared.save(reduce(DataFrame.unionByName, done), "posteriors"), n, good, strengths)


ADDED = ["document_odds", "site_odds", "quality_score", "accepted"]


def score(documents: DataFrame, labels: DataFrame, model: Model, *, keep: list[str] | None = None, label: str = "quality") -> DataFrame:
    """Adds document_odds and site_odds (log-odds), quality_score (their sum as a probability) and accepted (0.5 or more).

    Null and empty texts are judged by their features like others; a null source is
    the empty host; a site without labels has the rate of the one above it; rows that repeat get equal scores;
    without labels the classifier gives one half; an empty table stays empty.  ``keep`` names the columns to
    carry along (all); those that bear an added name are refused, other names never clash.
    """
    keep = documents.columns if keep is None else keep
    if clash := set(ADDED) & set(keep):
        raise ValueError(f"columns that the result adds exist already: {sorted(clash)}")
    known = site_posteriors(documents, labels, label=label)
    few = known.table.count() <= BROADCAST_SITES
    source = F.col("source") if "source" in documents.columns else F.lit(None).cast("string")
    # One column holds what is carried along, so that no name can clash.
    rows = documents.select(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("doc_id").alias("id"), sites(source).alias("sites"), "text")
    out = T.StructType([*(f for f in rows.schema if f.name != "text"), T.StructField("document_odds", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.let_go()
        for batch, texts in words.blocks(batches):
            x = np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "sites")), pa.array(model.log_odds(x))], names=out.names)

    # Dealt by id at every size, since labels may grow with the documents; rows without an id, which has no label, are spread.
    spread = F.when(F.col("id").isNull(), F.xxhash64("row")).otherwise(F.lit(0).cast("long"))
    own = _labels(labels, label).select(F.struct("id", F.lit(0).cast("long").alias("spread")).alias("key"), "label").hint("shuffle_hash")
    scored = rows.mapInArrow(run, out).withColumn("key", F.struct("id", spread.alias("spread"))).join(own, "key", "left")
    own_n, own = F.when(F.col("label").isNull(), 0).otherwise(1), F.coalesce(F.col("label"), F.lit(0))
    prior = rate = (F.lit(known.good + 0.5) - own) / (F.lit(known.n + 1) - own_n)
    for level in range(LEVELS):
        counts = known.table.where(F.col("level") == level).select(F.col("site").alias(f"site{level}"), F.col("n").alias(f"n{level}"), F.col("good").alias(f"good{level}"))
        scored = scored.withColumn(f"site{level}", F.get("sites", F.lit(level))).join(F.broadcast(counts) if few else counts, f"site{level}", "left")
        k = known.strengths[level]
        rate = F.when(F.col(f"n{level}").isNull(), rate).otherwise((F.col(f"good{level}") - own + k * rate) / (F.col(f"n{level}") - own_n + k))
    odds = lambda p: F.log(p / (1 - p))
    total = F.col("document_odds") + F.col("site_odds")
    return (
        scored.select(*[F.col("row").getField(c).alias(c) for c in keep], "document_odds", (odds(rate) - odds(prior)).alias("site_odds"))
        .withColumn("quality_score", 1 / (1 + F.exp(-total))).withColumn("accepted", total >= 0)
    )


def keep_good(documents: DataFrame, labels: DataFrame, model: Model) -> DataFrame:
    """The accepted documents, with their own columns, whatever their names.

    Null and empty texts stay or go by their scores (see ``score``); rows that repeat
    share one fate; an empty table stays empty.
    """
    renamed, back = shared.aside(documents, ADDED)
    return score(renamed, labels, model).where("accepted").drop(*ADDED).withColumnsRenamed(back)
