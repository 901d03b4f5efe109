"""Near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest

from codeloom.llm import decontaminate, neardup, quality, toxicity


def shingles(text, size):
    own = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if len(own) >= size else {tuple(own)} if own else set()


def brute(rows, size, percent):
    """Row numbers to (set size, smallest doc_id reachable)."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if percent * len(sets[j]) > 100 * len(sets[i]):
                break
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), low.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def ours(spark, rows, size, percent):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, shingle=size, percent=percent).collect()), key=str)


def made(seed):
    r = random.Random(seed)
    rows = [(0, None), (1, ""), (2, "  \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "one two three"), (None, "one two"), (7, "two one")]
    for _ in range(6):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([12, 40, 300]))]
        for _ in range(r.choice([2, 5, 40])):
            copy = list(base)
            for _ in range(r.randrange(0, 1 + len(base) // 25)):
                copy[r.randrange(len(copy))] = f"v{r.randrange(10**6)}"
            rows.append((r.randrange(10, 10**6), " ".join(copy)))
        rows += [(r.randrange(10, 10**6), " ".join(base))] * 3
    chain = [f"c{i}" for i in range(200)]
    for i in range(25):  # neighbours are alike, ends are not
        rows.append((2_000_000 - i, " ".join(chain[i * 4 :] + [f"d{k}" for k in range(i * 4)])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_components_equal_brute_force(spark, seed, size, percent):
    rows = made(seed)
    assert ours(spark, rows, size, percent) == brute(rows, size, percent)


def test_components_of_the_small_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert ours(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_keep_first(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(5, text, "a"), (3, text.upper(), "b"), (9, text + " more", "c"), (7, "other words here", "d"), (8, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = neardup.keep_first(df)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == [3, 7, 8]
    assert neardup.keep_first(df.limit(0)).count() == 0


def test_keep_first_chooses_rows(spark):
    text = " ".join(f"w{i}" for i in range(100))
    other, third = (" ".join(f"{k}{i}" for i in range(50)) for k in "vu")
    rows = [
        (3, text, "stays"), (None, text + " more", "goes"), (None, other, "stays"), (None, None, "stays"), (None, "", "stays"),  # null ids
        (9, text + " again", "goes"), (9, "a text of its own", "stays"),  # one id, two texts
        (20, third, "one"), (20, third, "one"), (20, third.upper(), "one"), (21, third, "goes"),  # one id, one text
        (None, "nobody has any id here", "lone"), (None, "nobody has any id here", "lone"),
    ]
    got = sorted(r["kept"] for r in neardup.keep_first(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect())
    assert got == ["lone", "one", *["stays"] * 5]


def test_filtering_stages_keep_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(100))
    names = ["row", "row_", "gone", "stays", "component", "digest", "Score", "own_Score", "predicted", "accepted", "own_accepted", "n_hit", "__n_hit", "id", "label"]
    rows = [(i, t, *[f"{c}{i}" for c in names]) for i, t in [(1, text), (2, text), (3, None), (4, "other words here")]]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    tests = spark.createDataFrame([("x", "never seen anywhere")], "item_id string, text string")
    got = neardup.keep_first(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [rows[k] for k in (0, 2, 3)]
    for got in (
        quality.keep_good(df, labels, quality.learn(df, labels)),
        toxicity.remove_toxic(df, toxicity.learn(df, labels)),
        decontaminate.remove_contaminated(df, tests),
    ):
        assert got.columns == df.columns and sorted(map(tuple, got.collect())) == rows


def test_odd_sketch_estimates():
    r = np.random.default_rng(0)
    for same in (0.8, 0.9):
        flips = []
        for _ in range(60):
            both = r.integers(0, 1 << 62, int(1000 * same)).astype(np.uint64)
            sets = [np.concatenate([both, r.integers(0, 1 << 62, 1000 - len(both)).astype(np.uint64)]) for _ in range(2)]
            a, b = neardup.odd_sketches(neardup.minhashes(sets)).view(np.uint64)
            flips.append(sum(int(x).bit_count() for x in a ^ b))
        assert max(flips) <= neardup.most_flips(same / (2 - same))
        n = 64 * neardup.ODD_WORDS
        estimate = 1 + n / 4 / (neardup.BANDS * neardup.ROWS) * np.log(1 - 2 * np.mean(flips) / n)
        assert abs(estimate - same / (2 - same)) < 0.02


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (5, 4)]
    got = neardup.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r[0], r[1]) for r in got) == sorted([(i, 0) for i in range(41)] + [(100 + k, 100) for k in range(30)])
