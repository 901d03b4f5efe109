"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import chat, decontaminate, lm, neardup, negatives, pieces, planes, quality, repeats, runs, shared, sharding, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = planes.word_encoder(public_tokenizers.path("word_bpe_49k.json"), end=2)
    return planes.read_tokens(planes.write_tokens(table(spark, sf_dir, "documents"), encoder))


def held_out(remainder: int):
    """Whether CRC-32 of a row's doc_id as text leaves ``remainder`` when divided by 5 (null ids: no)."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == remainder, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(documents, table(spark, sf_dir, "labels").where(~held_out(0)))
    return toxicity.score(documents, model).select("doc_id", held_out(0).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = r"\\### Assistant: </turn> ok"
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{says}'), (-7L, 1L, 'assistant', '{says}') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.conversation_digests(shared.save(chat.format_windows(turns), "chat"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm.train(documents.where(~held_out(1)))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return lm.score(documents, model).withColumn("held_out", held_out(1)).select(*names)


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.whole(table(spark, sf_dir, "embeddings")), k=5, every=50)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.drop("items")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score(documents, labels, quality.learn(documents, labels), keep=["doc_id"])


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(F.encode(text, "UTF-8"))
    assigned = sharding.assign_shards(table(spark, sf_dir, "documents"), ["doc_id"], stable=True)
    sharding.write_shards(assigned, path := shared.new_dir(spark, "shards"))
    out = spark.read.schema(assigned.schema).parquet(path)
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def with_periods(documents: DataFrame) -> DataFrame:
    """doc_id and text; the texts of about one id in ten go on from some word with a stretch before it, again and again."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    part = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = documents.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, part).alias("w"))
    rows = rows.withColumns({"n": F.size("w").cast("long"), "g": F.floor(F.col("h") / 10)})
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_periods(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    length = -F.col("best.less")
    return rows.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole(table(spark, sf_dir, "embeddings").where("label IS NOT NULL"), keep=("label",))
    label = F.col("label").cast("long")
    return negatives.hard_negatives(vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_bit_planes": op2_bit_planes,
    "op3_toxicity": op3_toxicity,
    "op4_chat_windows": op4_chat_windows,
    "op5_language_model": op5_language_model,
    "op6_top_k": op6_top_k,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_sharding": op10_sharding,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op6_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op9_near_duplicates": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])) END)) AS g FROM w
        ), n AS (SELECT w.doc_id, count(g) AS n_shingles FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id), i AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
        ), link AS (
            SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b
            WHERE 100 * i.n >= 85 * (x.n_shingles + y.n_shingles - i.n)
        ), reach AS (
            SELECT doc_id, doc_id AS other FROM n UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other
        ), c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT n.doc_id, n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c ON n.doc_id = c.doc_id
    """,
    "op11_substring_dedup": """
        WITH w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), g AS (
            SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13
        ), k AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM g
        ), f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k
        ), hit AS (SELECT k.doc_id, unnest(range(k.i, k.i + 13)) AS i FROM k JOIN f ON k.k = f.k AND f.first < k.doc_id
        ), gone AS (SELECT doc_id, list_sort(list_distinct(list(i))) AS gone FROM hit GROUP BY doc_id
        ), kept AS (
            SELECT w.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
                CASE WHEN gone IS NULL THEN w ELSE (SELECT coalesce(list(w.w[j] ORDER BY j), []) FROM range(1, len(w.w) + 1) r(j) WHERE NOT list_contains(gone, j)) END AS kept
            FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id
        )
        SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM kept
    """,
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS anchor_id, c.vec_id AS id, q.label = c.label AS same, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0
        ), p AS (
            SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same AND id <> anchor_id
        ), n AS (
            SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank
            FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE p.r <= 5
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
    """,
}
