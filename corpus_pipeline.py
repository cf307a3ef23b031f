"""The corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. The first four return the columns of
documents; the last returns each document's ids. run() writes every stage to the shared folder and reads it again, so
a lost executor repeats at most a part of one stage. What a stage wrote on its way goes when its result stands, and
that result when the next one stands; at the end only the last is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenderlens.llm import bpe, decontaminate, langid, pii, queries, simhash
from tenderlens.llm.common import clearing, drop_written, table, written

#: Below this share of known n-grams a text is in none of the learned languages.
LEAST_SCORE = 0.1

#: The stages walk automata, hash and align, which SQL cannot express; tests/llm holds them against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without letters or of no known language go."""
    named = langid.identify(docs, langid.learn(docs), keep=tuple(c for c in docs.columns if c != "doc_id"))
    return named.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms of the same format."""
    safe = pii.pseudonymize(docs, queries.PII_KEY, count_col="_n_private")
    return safe.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256 of every document."""
    coded = bpe.encode_decode(docs, queries.vocabulary("byte_bpe_50k.json"), keep=("lang", "source"))
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", decontamination),
    ("personal data", private_data),
    ("BPE encoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with clearing() as keep:
            docs = keep(written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-")))
        if before is not None:
            drop_written(before)
        before = docs
    return docs
