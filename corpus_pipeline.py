"""The corpus pipeline: documents that pass the quality classifier, one of each near-duplicate class, without repeated
passages, mixed to target weights and encoded. Every stage works on the whole of what the one before it kept.

All stages take any rows of documents' columns. A null text counts as empty. Columns that documents has beside its own
five pass through the first four stages. An empty table goes through all stages as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, mixing, neardup, quality, substring
from tidelog.llm._stage import table

#: Documents that score less are rejected.
LEAST_QUALITY = 0.7


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from all labels of documents at hand, does not reject.

    Empty texts and texts without words score 0 and go. Where a class has no label, all texts with words
    stay. Repeated rows are judged alike.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).filter(F.col("quality_score") >= LEAST_QUALITY).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least id.

    Null ids come after all others; of several texts under the least id the one with the least MD5
    stays, and of repeated rows one. All empty and null texts are one class.
    """
    return neardup.drop_near_duplicates(docs)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without word sequences of 20 words and more that occurred earlier.

    Earlier is a smaller id, null ids last, or an earlier place in the document. Repeated rows are one
    document and keep the same words. n_chars is that of the text that is left.
    """
    kept = substring.remove_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times.

    A null source is a source of its own. Documents without words are not taken.
    """
    taken = mixing.mix_to_weights(docs).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian unsigned 32-bit), with digests of them and of what they decode to.

    An empty text has no ids. Every row is encoded, repeated ones as often as they occur.
    """
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    decoded = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN).drop("text"), ranks)
    return decoded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", good_quality), ("near_dedup", one_of_each), ("substring_dedup", no_repeats), ("mixing", mixed), ("bpe", encoded)]

#: The classifier, the signatures and the tokenizer are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the stages before are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
