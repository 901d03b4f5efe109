"""Decontamination, planes, sharding and chat windows against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import chat, decontaminate, planes, queries, sharding

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_contamination(docs, items):
    windows = []
    for item, text in items:
        own = WORD.findall(lower(text))
        size = min(13, len(own))
        windows += [(tuple(own[i : i + size]), str(item)) for i in range(len(own) - size + 1 if own else 0)]
    out = {}
    for doc, text in docs:
        own, hit, found = WORD.findall(lower(text)), set(), set()
        for w, item in windows:
            for i in range(len(own) - len(w) + 1):
                if tuple(own[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found.add(item)
        names = ",".join(sorted(found))
        out[doc] = (len(own), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(own))
    return out


def random_texts(seed):
    r = random.Random(seed)
    vocabulary = ["the", "of", "A", "b", "Éa", "é", "x1", "cat"]
    text = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 2, 5, 13, 14, 40]))) for i in range(12)] + [(99, None), (10, "zebra")]
    docs = [(i, text(r.choice([0, 1, 3, 20, 200]))) for i in range(30)]
    docs += [(100 + i, text(20) + " . " + (items[i][1] or "") + " . " + text(30 * i)) for i in range(12)] + [(200, None), (201, ""), (202, "zebra!")]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_contamination_equals_brute_force(spark, seed, monkeypatch):
    docs, items = random_texts(seed)
    if seed == 2:
        monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 40)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_contamination(d, b).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows}
    assert got == brute_contamination(docs, items)
    kept = {r["doc_id"] for r in decontaminate.remove_contaminated(d, b).collect()}
    assert kept == {k for k, v in got.items() if not v[-1]}


def test_contamination_extends_to_the_longest_match(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"a b {passage[:-4]} zz", "x")], "doc_id long, text string, n_words string")
    items = spark.createDataFrame([(7, f"q {passage} r", 5)], "item_id long, text string, doc_id int")
    with pytest.raises(ValueError, match="n_words"):
        decontaminate.find_contamination(docs, items)
    row = decontaminate.find_contamination(docs.drop("n_words"), items).first()
    assert (row["longest"], row["longest_at"], row["longest_item"], row["n_hit"]) == (29, 2, "7", 29)
    assert decontaminate.remove_contaminated(docs, items).columns == docs.columns


def test_contamination_finds_the_longest_of_shared_windows(spark, monkeypatch):
    shared_ = " ".join(f"w{i}" for i in range(15))
    items = [(1, f"{shared_} x1 x2"), (2, f"q {shared_} y1 y2 y3 y4"), (3, f"{shared_} y1 z"), (4, f"{shared_} x1 x2"), (5, "w3 w4")]
    docs = [(1, f"{shared_} y1 y2 y3 n"), (2, f"a {shared_} x1 x2 {shared_}"), (3, f"{shared_} y1"), (4, "w3 w4"), (5, f"{shared_} q"), (6, "none here")]
    expect = {1: (18, 0, "2"), 2: (17, 1, "1"), 3: (16, 0, "2"), 4: (2, 0, "5"), 5: (15, 0, "1"), 6: (0, None, None)}
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (decontaminate.CHUNK_BYTES, 60):  # what chunk an item falls into decides nothing
        monkeypatch.setattr(decontaminate, "CHUNK_BYTES", size)
        rows = decontaminate.find_contamination(d, b).collect()
        assert {r["doc_id"]: (r["longest"], r["longest_at"], r["longest_item"]) for r in rows} == expect


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), max_size=6), st.lists(st.sampled_from("abcd"), max_size=60))
@settings(max_examples=60, deadline=None)
def test_longest_match_equals_brute_force(items, doc):
    test = decontaminate.TestSide([(f"i{k}", " ".join(x).encode()) for k, x in enumerate(items)], 4)
    _, found, best = decontaminate.search(test, [[w.encode() for w in doc]])
    longest, owners = (0, -1, None), set()
    for k, own in enumerate(items):
        size = min(4, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            for p in range(len(doc) - size + 1):
                if doc[p : p + size] == own[i : i + size]:
                    owners.add(f"i{k}")
                    n = size
                    while p + n < len(doc) and i + n < len(own) and doc[p + n] == own[i + n]:
                        n += 1
                    longest = min(longest, (n, p, f"i{k}"), key=lambda x: (-x[0], x[1], x[2] or ""))
    assert found[0] == owners and best[0] == longest


def test_very_long_verbatim_matches(spark):
    passage = [f"w{i % 7919}x{i % 10_007}" for i in range(200_000)]
    items = spark.createDataFrame([("a", " ".join(passage)), ("b", " ".join(passage[1000:150_000])), ("a", " ".join(passage))], "item_id string, text string")
    docs = [(1, passage), (2, ["q", *passage[500:160_001], "q", *passage[:20]]), (3, [*passage[990:1010], "none"]), (4, passage[1000:150_000])]
    rows = decontaminate.find_contamination(spark.createDataFrame([(k, " ".join(x)) for k, x in docs], "doc_id long, text string"), items).collect()
    got = {r["doc_id"]: (r["n_hit"], r["items"], r["longest"], r["longest_at"], r["longest_item"]) for r in rows}
    assert got == {1: (200_000, ["a", "b"], 200_000, 0, "a"), 2: (159_521, ["a", "b"], 159_501, 1, "a"), 3: (20, ["a"], 20, 0, "a"), 4: (149_000, ["a", "b"], 149_000, 0, "a")}


def test_contamination_of_a_very_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "word " * 400_000 + passage + " word" * 1000)], "doc_id long, text string")
    row = decontaminate.find_contamination(docs, spark.createDataFrame([(3, passage)], "item_id long, text string")).first()
    assert (row["n_words"], row["n_hit"], row["longest"], row["longest_at"], row["contaminated"]) == (401_040, 40, 40, 400_000, False)


def test_contamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, items).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert not decontaminate.find_contamination(one, items).first()["contaminated"]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50), st.booleans())
@settings(max_examples=50, deadline=None)
def test_plane_round_trip(ids, bits):
    ids = np.array(ids, np.uint32)
    assert planes.unshuffle(planes.shuffle(ids, bits)).tolist() == ids.tolist()


@pytest.mark.parametrize("bits", [False, True])
def test_plane_files(tmp_path, bits):
    r = np.random.default_rng(1)
    docs = [(i if i % 5 else None, r.integers(0, 2**32 if i == 3 else 50_000, n, dtype=np.uint32)) for i, n in enumerate([0, 1, 70_000, 5, 0, 200_000, 3])]
    assert planes.write_file(uri := str(tmp_path / "x.planes"), iter(docs), bits) == (7, 270_009)
    reader = planes.Reader(uri)
    assert [(a, x.tolist()) for a, _, x in reader.documents()] == [(a, x.tolist()) for a, x in docs]
    whole = np.concatenate([x for _, x in docs])
    assert reader.span(65_000, 140_001).tolist() == whole[65_000:140_001].tolist()


ODD = [None, "", " ", "<|endoftext|> a<|startoftext|>b < |", "<|ENDOFTEXT|> A.. b., c.d .e, Ñé. Œuvre, naïve,", "It's don't WE'LL x'S 's", "ΑΣ ΑΣ.", "́x ́y", "a\x1cb \x85c d", "İstanbul ǅ ½ ² ٣", "日本語 🙂🙂 x", "ﬁ Å ª º", "word " * 3000]


def test_word_encoder_equals_library(spark, sf_dir):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(i, x) for i, x in enumerate(ODD)] + [(3, "again"), (None, "no id")]
    more = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows += [(1000 + r["doc_id"], r["text"]) for r in more]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = planes.read_tokens(planes.write_tokens(docs, planes.word_encoder(path, end=2))).collect()
    got = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    expect = Counter()
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        expect[doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == expect


def test_tokens_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert planes.read_tokens(planes.write_tokens(docs, planes.word_encoder(public_tokenizers.path("word_bpe_49k.json")))).count() == 0


def test_communication_matrix_is_exact_and_fair():
    parts, shards = [7, 0, 13, 5], sharding.shard_sizes(25, 4)
    for seed in range(20):
        m = sharding.communication_matrix(parts, shards, seed)
        assert [sum(r) for r in m] == parts and [sum(c) for c in zip(*m, strict=True)] == shards
    draws = [sharding.hypergeometric(random.Random(i), 30, 70, 10) for i in range(4000)]
    assert abs(np.mean(draws) - 3) < 0.1 and abs(np.var(draws) - 10 * 0.3 * 0.7 * 90 / 99) < 0.15
    big = sharding.hypergeometric(random.Random(1), 10**10, 15 * 10**10, 10**9)
    assert abs(big - 10**9 / 16) < 10 * 10**4.5


def test_communication_matrix_of_many_parts():
    parts = [50_000 + k % 1000 for k in range(10_000)]
    shards, began = sharding.shard_sizes(sum(parts), 16), time.monotonic()
    m = np.array(sharding.communication_matrix(parts, shards, 3))
    assert time.monotonic() - began < 60 and m.sum(axis=1).tolist() == parts and m.sum(axis=0).tolist() == shards
    assert abs(m / np.array(parts)[:, None] - 1 / 16).max() < 0.01


def test_shards_deal_rows_of_one_id_alike_when_tasks_run_again(spark, tmp_path):
    rows = [(k % 3, f"text {k % 700}", {"k": k % 700}) for k in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>").repartition(6).write.parquet(path := str(tmp_path / "rows"))
    deal = lambda: Counter((r["text"], r["shard"], r["slot"]) for r in sharding.assign_shards(spark.read.parquet(path), ["doc_id"], 16, stable=True).collect())
    one = deal()
    assert one == deal() and Counter(t for t, *_ in one.elements()) == Counter(r[1] for r in rows)
    assert set(Counter(s for _, s, _ in one.elements()).values()) == {125}


def test_shards_are_exact(spark):
    rows = [(i if i % 10 else None, f"t{i % 40}") for i in range(1003)] + [(5, "same")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign_shards(df, ["doc_id", "text"], 16).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(16)) and {len(x) for x in by.values()} == {63, 64}
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sharding.assign_shards(df.limit(0), ["doc_id", "text"]).count() == 0


def test_shards_differ_by_seed_and_repeat(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    one, same, other = (sorted(map(tuple, sharding.assign_shards(df, ["doc_id"], 4, seed).collect())) for seed in (1, 1, 2))
    assert one == same != other


def test_shard_files(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "doc_id")
    sharding.write_shards(sharding.assign_shards(df, ["doc_id"], 4), path := str(tmp_path / "s"))
    assert {r["shard"]: r["count"] for r in spark.read.parquet(path).groupBy("shard").count().collect()} == dict.fromkeys(range(4), 25)


def test_shards_carry_whole_rows(spark):
    rows = [(i % 50 if i % 7 else None, f"text {i}") for i in range(300)]  # ids do not tell rows apart
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], 4).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(4) for k in range(75)]


def test_shards_of_odd_columns_and_long_texts(spark):
    rows = [(i, i % 3, "p", "x" * (2_000_000 if i == 7 else i), None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, cell int, part string, text string, row string")
    got = sharding.assign_shards(df, ["doc_id"], 3)
    assert got.columns == [*df.columns, "shard", "slot"]
    assert Counter(tuple(r)[:5] for r in got.collect()) == Counter(rows)
    with pytest.raises(ValueError, match="shard"):
        sharding.assign_shards(df.withColumnRenamed("cell", "Shard"), ["doc_id"])


def test_shards_move_rows_once(spark, sf_dir):
    plan = sharding.assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], stable=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_sharding_query_writes_the_documents(spark, sf_dir, monkeypatch):
    written, write = [], sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda df, path: (written.append(path), write(df, path)))
    out = queries.op10_sharding(spark, sf_dir).collect()
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = spark.read.parquet(*written)
    assert Counter(map(tuple, shards.select(documents.columns).collect())) == Counter(map(tuple, documents.collect()))
    digest = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in out) == Counter((r["doc_id"], *digest(r["text"]), r["shard"], r["slot"]) for r in shards.collect())


def brute_chat(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((-1e99 if turn is None else turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = [t for _, r, t in turns if r == "assistant"]
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        out[conv] = (len(turns), digest, sum(map(len, loss)), hashlib.sha256("".join(loss).encode()).hexdigest())
    return out


def random_conversations(seed):
    r = random.Random(seed)
    rows = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (3, 0, "system", "alone"), (None, 0, "user", None), (None, 1, None, "x\n<turn>\\b\\l\\")]
    for conv in range(10, 20):
        for turn in range(r.choice([1, 2, 5, 40, 600])):
            role = "system" if turn == 0 and conv % 2 else ["user", "assistant"][turn % 2]
            rows.append((conv, turn, role, r.choice(["a </turn>\n b", "", "é🙂 " * r.randrange(30), "word " * r.randrange(60), "\\l\\b<", "w " * 2000 if turn % 50 == 7 else "q"])))
    rows += [(50, 0, "we\nird<\\", "t"), (50, 0, "assistant", "tie"), (50, 0, "assistant", "tie"), (50, None, "assistant", "first")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_chat_digests_equal_brute_force(spark, seed):
    rows = random_conversations(seed)
    turns = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, window int")
    windows = chat.format_windows(turns, budget=600, history=100)
    got = {r[0]: tuple(r[1:5]) for r in chat.conversation_digests(windows).collect()}
    assert got == brute_chat(rows)
    assert chat.conversation_digests(chat.format_windows(turns.limit(0))).count() == 0


def chat_windows(spark, rows, **options):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long" if len(rows[0]) == 5 else "conv_id long, turn long, role string, text string")
    return sorted(chat.parse_windows(chat.format_windows(turns, **options)).collect(), key=lambda r: (r["conv_id"], r["window"]))


def test_chat_windows_keep_budget_history_and_system(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, ["assistant", "user"][i % 2], f"turn{i} " + "w " * (i % 7)) for i in range(1, 90)]
    windows = chat_windows(spark, rows, budget=400, history=120)
    assert len(windows) > 10
    texts = [[x.split("\n", 1)[1] for x in w["formatted"].split("</turn>\n")[:-1]] for w in windows]
    at = {x[3]: x[1] for x in rows}
    for i, (w, own) in enumerate(zip(windows, texts, strict=True)):
        assert own[0] == "be kind" and (w["n_repeated"] > 0) == (i > 0)
        assert len(w["formatted"].encode()) <= 400
        places = [at[x] for x in own[1:]]
        assert places == list(range(places[0], places[0] + len(places)))  # history and new turns are next to each other
        assert sum(w["formatted"][s["start"] : s["start"] + s["length"]] in w["targets"] for s in w["loss"]) == len(w["targets"])
    assert any(w["n_repeated"] > 2 for w in windows)
    assert sum(len(w["formatted"].encode()) for w in windows) / len(windows) > 400 / 2
    assert [t for w in windows for t in w["targets"]] == [x[3] for x in rows if x[2] == "assistant"]


def test_chat_long_turns_stand_alone_and_hide_older_history(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"t{i} " + "x" * (700 if i % 9 == 4 else 5)) for i in range(40)]
    windows = chat_windows(spark, rows, budget=400, history=150)
    for w in windows:
        own = [int(x.split("\nt", 1)[1].split(" ")[0]) for x in w["formatted"].split("</turn>\n")[:-1]]
        assert own == list(range(own[0], own[0] + len(own)))
        fresh = own[w["n_repeated"] :]
        assert len(w["formatted"]) <= 400 or len(fresh) == 1 and fresh[0] % 9 == 4
    assert [t for w in windows for t in w["targets"]] == [x[3] for x in rows if x[2] == "assistant"]


def test_chat_copies_a_system_turn_only_as_often_as_windows_need(spark):
    system, long = "s" * 20_000, "word " * 4_000_000
    rows = [(1, 0, "system", system), (1, 1, "user", long), (1, 2, "assistant", "yes"), (2, 0, "system", "be brief"), *[(2, k, "user", f"turn {k}") for k in range(1, 60)]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(turns)
    got = {(r["conv_id"], r["window"]): len(r["formatted"]) for r in windows.collect()}
    assert sum(n for (k, _), n in got.items() if k == 1) < 20_000_000 + 3 * 21_000 and max(w for _, w in got) < 40
    assert {r[0]: tuple(r[1:5]) for r in chat.conversation_digests(windows).collect()} == brute_chat(rows)


def test_chat_takes_given_token_counts(spark):
    rows = [(1, i, "assistant", f"t{i}", n) for i, n in enumerate([10, 10, 10, 10, None, -3, 0, 90, 10])]
    windows = chat_windows(spark, rows, budget=60, history=0, tokens="n")
    assert [[x for x in w["targets"]] for w in windows] == [["t0", "t1", "t2"], ["t3", "t4", "t5", "t6"], ["t7"], ["t8"]]
    free = chat_windows(spark, [(1, i, "assistant", f"t{i}", 0) for i in range(4)], budget=60, history=20, tokens="n")
    assert [w["targets"] for w in free] == [["t0", "t1", "t2", "t3"]]
    with pytest.raises(ValueError, match="history"):
        chat_windows(spark, rows, budget=60, history=60)


def test_chat_cost_bounds_real_tokenizers(spark, sf_dir):
    import sentencepiece
    from tokenizers import Tokenizer

    texts = ["", "日本語の文章です。" * 500, "漢" * 8000, "qxzj" * 25_000, "a" * 100_000, "🙂" * 300, "a\\b <turn> </turn>", "  \n\t ", "1234567890 !?"]
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text IS NOT NULL").limit(200).collect()]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", chat.bound(chat.F.lit("assistant"), chat.F.col("text")).alias("n")).collect()
    pieces_ = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    words_ = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for text, n in rows:
        turn = "<turn>assistant\n" + text.replace("\\", "\\b").replace("<", "\\l") + "</turn>\n"
        assert n >= len(pieces_.encode(turn)) and n >= len(words_.encode(turn, add_special_tokens=False).ids)


def test_registered_queries_on_the_small_tables(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in queries.op7_decontamination(spark, sf_dir).collect()}
    assert got == brute_contamination(docs, items)
    talks = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    says = "\\### Assistant: </turn> ok"
    got = {r[0]: tuple(r[1:5]) for r in queries.op4_chat_windows(spark, sf_dir).collect()}
    assert got == brute_chat([*talks, (-7, 0, "user", says), (-7, 1, "assistant", says)])
    rows = queries.op10_sharding(spark, sf_dir).collect()
    texts = dict(docs)
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in rows)
