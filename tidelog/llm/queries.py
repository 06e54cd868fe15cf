"""One query per corpus operator, over whole tables, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from tidelog.llm import ann, bpe, chat, fingerprint, mixing, neardup, quality, sharding, substring, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.lit("key").alias("law"))
    return sharding.numbered(sharding.assign_shards(slim, 16), columns=("doc_id", "size", "text_crc32"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.held_out_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), folds=4, fold_out=2)
    return scored.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = neardup.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    copies = classes.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return copies.select("doc_id", "class_id", "class_size")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(rows, rows.filter("vec_id % 20 = 0"), k=20)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(chat.as_streamed_events(chats.union(extra))))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.held_out_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), folds=5, fold_out=0)
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    mixed = mixing.mix_to_weights(docs, weights=(5, 2, 1), repeats=3, size=F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text"), ranks)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = substring.remove_repeats(docs, window=20, joined=True)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_toxicity": op7_toxicity,
    "op8_source_mixing": op8_source_mixing,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_substring_dedup": op10_substring_dedup,
}

_CHAT_SQL = r"""
WITH every AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), rendered AS (
    SELECT *,
        replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), chr(10), '\n') AS role_out,
        replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS text_out
    FROM every
)
SELECT conv_id,
    CAST(count(*) AS BIGINT) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(14 + length(role_out) + length(text_out)) AS BIGINT) AS formatted_chars
FROM rendered GROUP BY conv_id
"""

_MIX_SQL = r"""
WITH docs AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
        md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
    FROM documents
), sums AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM docs GROUP BY source
), weighed AS (
    SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS most FROM sums
), filling AS (
    SELECT *, most / weight AS fills,
        CAST(sum(most) OVER w - most AS BIGINT) AS full_words,
        CAST((SELECT sum(weight) FROM weighed) - sum(weight) OVER w + weight AS BIGINT) AS open_weight
    FROM weighed WINDOW w AS (ORDER BY most / weight, place)
), levels AS (
    SELECT *, (CAST((SELECT sum(source_size) FROM sums) AS BIGINT) - full_words) / open_weight AS level FROM filling
), goals AS (
    SELECT source, source_size, least(CAST(most AS DOUBLE), weight * (SELECT level FROM levels WHERE level <= fills ORDER BY fills, place LIMIT 1)) AS target FROM levels
), queued AS (
    SELECT d.*, g.source_size, g.target,
        CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
    FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
), items AS (
    SELECT doc_id, source, key, turn, size, (source_size * turn + upto) / target AS finish
    FROM queued, (VALUES (0), (1), (2)) t(turn) WHERE size > 0 AND target > 0
), kept AS (
    SELECT doc_id, source, key, size, count(*) FILTER (given <= (SELECT sum(source_size) FROM sums)) AS copies
    FROM (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, key, turn ROWS UNBOUNDED PRECEDING) AS given FROM items)
    GROUP BY doc_id, source, key, size
)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(k.copies, 0) * q.size AS BIGINT) AS taken
FROM queued q LEFT JOIN kept k ON q.key = k.key AND q.source IS NOT DISTINCT FROM k.source AND q.doc_id IS NOT DISTINCT FROM k.doc_id AND q.size = k.size
"""

_REPEATS_SQL = r"""
WITH split AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), windows AS (
    SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM split WHERE len(words) >= 20)
), firsts AS (
    SELECT h, min({'d': doc_id, 'i': i}) AS first FROM windows GROUP BY h HAVING count(*) > 1
), gone AS (
    SELECT DISTINCT doc_id, i + k AS i FROM windows JOIN firsts USING (h), (SELECT unnest(range(20)) AS k) WHERE doc_id <> first.d OR i <> first.i
), placed AS (
    SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM split
), kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op10_substring_dedup": _REPEATS_SQL,
    "op6_chat_formatting": _CHAT_SQL,
    "op8_source_mixing": _MIX_SQL,
}
