"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenderlens.llm import (ans, bpe, chat, ctph, decontaminate, html_extract, langid, phrases, pii, prefix_trie, quality, simhash,
                            token_counts)
from tenderlens.llm.common import table, written
from tenderlens.llm.sql import SQL  # noqa: F401  registered beside the queries


#: A production run takes its key from a secret store; results here must be repeatable.
PII_KEY = "registered-query"


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode_decode(docs, vocabulary("byte_bpe_50k.json")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = ans.store(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return ans.checksummed(ans.read(spark, place, packed=True))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs)).select(
        "doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "n_private")


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.edited_study(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit(r"\### Assistant: </turn> ok")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").cast("int").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    examples = written(chat.prefix_examples(turns.unionByName(extra)), "chat-examples")
    return chat.digests(examples)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_collocations(table(spark, sf_dir, "documents")).withColumnRenamed("grp", "lang")


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own_from = F.crc32(F.col("conv_id").cast("string")) % 9
    return prefix_trie.prefix_trie(prefix_trie.forked(
        prefix_trie.conversations(table(spark, sf_dir, "conversations")), 5, own_from))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted", "n_passages")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_bpe_encode_decode": op2_bpe_encode_decode,
    "op3_token_counts": op3_token_counts,
    "op4_token_id_output": op4_token_id_output,
    "op5_language_id": op5_language_id,
    "op6_html_extraction": op6_html_extraction,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_pii": op8_pii,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_conversation_prefix_trie": op12_conversation_prefix_trie,
    "op13_quality_classifier": op13_quality_classifier,
    "pipeline": pipeline,
}
