"""Repeated passages, periodic runs and hard negatives against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import negatives, queries, repeats, runs, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Repeated passages


def brute_repeats(docs, window=13):
    """(id, text) rows to (n_words, n_removed, kept) rows in their order."""
    first = {}
    for doc, text in docs:
        w = WORD.findall(text or "")
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in docs:
        w = WORD.findall(text or "")
        gone = {j for i in range(len(w) - window + 1) if doc is not None and first[tuple(w[i : i + window])] < doc for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def passages(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(r.choice([2, 6, 400]))] + ["É", "É", "A", "a"]
    text = lambda n: r.choice([" ", "\n", " \t\x0b"]).join(r.choice(vocabulary) for _ in range(n))
    shared_ = [text(n) for n in (12, 13, 14, 40, 200)]
    docs = [(i, " ".join(r.choice([text(r.choice([0, 1, 5, 30])), r.choice(shared_)]) for _ in range(r.choice([0, 1, 2, 6])))) for i in range(40)]
    docs += [(50, docs[3][1]), (-5, docs[4][1]), (7, docs[7][1]), (7, "other " + docs[8][1]), (None, docs[9][1]), (None, None), (60, None), (61, ""), (62, " \t ")]
    docs += [(100 + i, f"own{i} " + shared_[3] + f" end{i}") for i in range(30)]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", range(4))
def test_repeats_equal_brute_force(spark, seed, monkeypatch):
    docs = passages(seed)
    if seed == 1:
        monkeypatch.setattr(repeats, "BUCKET_BYTES", 1 << 12)
    if seed == 2:
        monkeypatch.setattr(repeats, "FREQUENT", 1e-2)
    rows = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(docs)], "doc_id long, text string, __id long").repartition(3)
    got = sorted((r["__id"], r["n_words"], r["n_removed"], r["kept"]) for r in repeats.remove_repeats(rows).collect())
    assert got == [(k, *x) for k, x in enumerate(brute_repeats(docs))]


def test_repeats_in_a_very_long_text_and_in_many_copies(spark):
    r = random.Random(5)
    passage = " ".join(f"p{r.randrange(10**6)}" for _ in range(60))
    long = " ".join(f"w{r.randrange(5000)}" for _ in range(150_000))
    docs = [(0, long), (1, "x " + long[: len(long) // 2]), *((k, f"a{k} b{k} {passage} c{k}") for k in range(10, 900)), *((k, passage) for k in range(900, 1000))]
    got = {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: x[:2] for (d, _), x in zip(docs, brute_repeats(docs), strict=True)}


def test_repeats_of_nothing_and_refused_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(empty).columns == ["doc_id", "text", "n_words", "n_removed", "kept"]
    assert repeats.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError, match="exist already"):
        repeats.remove_repeats(empty.selectExpr("*", "1 AS Kept"))
    out = repeats.remove_repeats(spark.createDataFrame([(1, "a b", "s", 2)], "doc_id int, body string, hash string, bucket int"), text="body")
    assert [tuple(x) for x in out.collect()] == [(1, "a b", "s", 2, 2, 0, "a b")]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 8, 12, 13, 14, 16])
def test_repeats_of_few_words(spark, n):
    docs = [(k, " ".join("abcdefghijklmnop"[:n])) for k in range(2)]
    got = sorted((r["n_words"], r["n_removed"]) for r in repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(n, 0), (n, n if n >= 13 else 0)]


def test_windows_of_equal_numbers_are_told_apart(monkeypatch):
    monkeypatch.setattr(repeats, "folded", lambda codes, n: np.zeros(max(0, len(codes) - n + 1), np.uint64))
    strings = [b"a b c d", b"b c d e", b"a b c e"]
    got = repeats.first_owners(strings, np.array([2, 1, 3]), 3)
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == [(0, 1, 4), (2, 0, 3)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(1, 12))
def test_least_of(values, n):
    got = repeats.least_of(np.array(values, np.uint64), n).tolist()
    assert got == [min(values[i : i + n]) for i in range(len(values) - n + 1)]


# Periodic runs


def brute_runs(w, shortest=6, periods=4):
    found = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            n = i - a + q
            smaller = any(all(w[x] == w[x + r] for x in range(a, a + n - r)) for r in range(1, q))
            if n >= max(shortest, periods * q) and not smaller:
                found.append((a, n, q))
    return sorted(found, key=lambda x: (x[0], x[2]))


def periodic_words(r):
    w = [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.choice([0, 1, 5, 6, 7, 24, 60]))]
    for _ in range(r.choice([0, 1, 2]) if w else 0):
        a, p = r.randrange(len(w)), 1 + r.randrange(6)
        b = min(len(w), a + p * r.randrange(2, 9))
        w[a:b] = [w[min(len(w) - 1, a + (i - a) % p)] for i in range(a, b)]
    return w


@pytest.mark.parametrize("least", [(6, 4), (1, 3), (2, 2)])
def test_runs_equal_brute_force(least):
    r = random.Random(least[0])
    for _ in range(1500):
        w = periodic_words(r)
        assert runs.runs_of(np.array(w, np.int64), *least) == brute_runs(w, *least)


def test_runs_do_not_trust_hashes(monkeypatch):
    monkeypatch.setattr(runs, "_MASK", 0)  # all hashes alike
    monkeypatch.setattr(runs, "NEAR", 1)
    r = random.Random(9)
    for _ in range(500):
        w = periodic_words(r)
        assert runs.runs_of(np.array(w, np.int64)) == brute_runs(w)


def test_runs_of_long_texts_take_linear_work():
    for w in ([0] * 200_000, [k % 7 for k in range(200_000)], [k % 40_000 for k in range(200_000)]):
        assert runs.runs_of(np.array(w, np.int64)) == [(0, 200_000, max(w) + 1)]


def brute_op12(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op12_equals_brute_force(spark, tmp_path):
    r = random.Random(3)
    docs = [(k, r.choice([" ", "\n\t"]).join(f"é{x}" for x in periodic_words(r))) for k in range(400)]
    docs += [(None, "a a a a a a a"), (10, None), (11, ""), (12, " \x0b "), (3, "b"), (3, "b"), (-4, "x y " * 30)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(path)
    got = sorted((tuple(x) for x in queries.op12_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((brute_op12(*d) for d in docs), key=str)
    assert sum(x[1] > 0 for x in got) > 50


def test_runs_carry_columns_and_refuse_names(spark):
    rows = spark.createDataFrame([("a b " * 5, 1, "x")], "text string, number int, `__row` string")
    assert [tuple(x) for x in runs.find_runs(rows).select("number", "__row", "n_words", "collapsed").collect()] == [(1, "x", 10, "a b")]
    assert runs.find_runs(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="exist already"):
        runs.find_runs(rows.withColumnRenamed("number", "RUNS"))


# Hard negatives


def brute_negatives(rows, every=100, positives=5, k=10):
    """(id, label, vector of whole numbers) rows; anchors are the first row of their id by label and vector."""
    anchors, out = {}, []
    for own, label, v in sorted(rows):
        if own % every == 0:
            anchors.setdefault(own, (label, v))
    for own, (label, v) in anchors.items():
        scores = sorted(((-sum(a * b for a, b in zip(v, x, strict=False)), i, y) for i, y, x in rows))
        near = [(i, -s) for s, i, y in scores if y == label and i != own][:positives]
        for i, p in dict.fromkeys(near):
            inside = [(j, -s) for s, j, y in scores if y != label and 30 * p <= -100 * s <= 90 * p][:k]
            out += [(own, i, rank, j, p, s) for rank, (j, s) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_negatives_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(negatives, "STRIPE", 150)
    monkeypatch.setattr(negatives, "BLOCK", 4)
    monkeypatch.setattr(negatives, "LEAF", 8)
    r = random.Random(seed)
    d, spread = r.choice([1, 3, 16]), r.choice([2, 50, 3000])
    rows = [(i, r.randrange(r.choice([1, 3])), [r.randrange(-spread // 4, spread) for _ in range(d)]) for i in range(700)]
    rows += [(1000 + i, r.randrange(2), rows[5][2]) for i in range(100)]  # one very common vector
    rows += [rows[6]] * 15 + [(100, 1, [0] * d), (200, 0, rows[200][2][:1]), (7, 1, [])]  # repeated rows, shorter vectors
    frame = spark.createDataFrame([(i, y, [float(x) for x in v]) for i, y, v in rows], "vec_id long, label long, v array<double>")
    got = sorted(tuple(x) for x in negatives.hard_negatives(frame).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == brute_negatives(rows)
    assert len(got) > 50


def test_trees_leave_rows_unread():
    r = np.random.default_rng(4)
    centres = r.integers(-2000, 2000, (20, 8))
    vectors = np.concatenate([c + r.integers(-40, 40, (200, 8)) for c in centres]).astype(float)
    tree = negatives.Tree(np.arange(4000), np.repeat(np.arange(20), 200), vectors)
    search = tree.searcher(vectors[0])
    best = search.nearest(tree.labels >= 0, 5)
    exact = vectors @ vectors[0]
    assert [s for s, _ in best] == sorted(exact.astype(int), reverse=True)[:5]
    assert tree.read < 2000


def test_negatives_take_odd_rows_of_the_table(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 0, [1.0, 0.5]), (1, 1, [1.0, 0.4]), (2, 0, [0.5, 0.2]), (None, 1, [0.5, 0.2]), (3, None, [0.5, 0.2]), (4, 1, None), (5, 1, [nan, 0.1]), (6, 1, [0.1, None]), (7, 1, [0.5, 0.2]), (8, 1, [inf, 0.0])]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [tuple(x) for x in queries.op13_hard_negatives(spark, str(tmp_path)).select("anchor_id", "positive_id", "rank", "negative_id").collect()]
    assert got == [(0, 1, 1, 2), (0, 1, 2, 7)]
    assert negatives.hard_negatives(topk.whole(spark.createDataFrame([], "vec_id long, label long, embedding array<float>"), keep=("label",))).count() == 0
