"""The operators over the given tables, with production parameters."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import alignment, chats, decontaminate, embeddings, licenses, lm_score, mixing, ngram_join, packing, quality, substrings, toxicity, variants
from postmill.llm.oracles import ORACLES as ORACLES


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; Python workers are told where this package is, for sessions started elsewhere."""
    environment = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, environment.get("PYTHONPATH")]))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of Jaccard similarity 0.8 and more between the 5-word shingles of all documents."""
    return ngram_join.jaccard_join(spark, read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = read(spark, sf_dir, "documents")
    lexicon, model = toxicity.fit(spark, docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(spark, docs.select("doc_id", "text"), lexicon, model)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the windows of 50 words that an earlier document holds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substrings.remove_repeats(spark, docs)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram stupid-backoff scores of all documents against all others."""
    scored = lm_score.stupid_backoff(spark, read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents, by windows of 13 words."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.benchmark_hits(spark, docs, read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan_licenses(docs)
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"])))
    count = lambda status: F.size(F.filter("licenses", lambda x: x["status"] == status)).cast("long")
    return found.select(
        "doc_id",
        "n_candidates",
        F.concat_ws(",", names).alias("licenses"),
        count("exact").alias("n_exact"),
        count("variant").alias("n_variant"),
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, with tool calls made from their turns, as linked canonical JSON."""
    table = chats.with_tool_calls(read(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(chats.SCHEMAS, "name string, argument string, type string, required boolean")
    return chats.format_chats(spark, table, schemas)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 and more among all embeddings."""
    return embeddings.near_duplicates(spark, read(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    scored = quality.score(spark, docs.select("doc_id", "text"), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack(spark, read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources with weights 1, 2, 3 takes from each document."""
    allotted = mixing.allot(spark, read(spark, sf_dir, "documents"))
    return mixing.rows_taken(allotted).select("doc_id", "size", "source_size", "target", "taken")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return variants.group_variants(spark, read(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents tokenised twice, their tokens linked where both sides meet."""
    docs = read(spark, sf_dir, "documents")
    return alignment.align(spark, docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_lm_score": op4_lm_score,
    "op5_decontaminate": op5_decontaminate,
    "op6_license_scan": op6_license_scan,
    "op7_chat_format": op7_chat_format,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_mixing": op11_mixing,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_token_alignment": op13_token_alignment,
}
