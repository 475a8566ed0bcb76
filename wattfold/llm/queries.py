"""The subpackage's registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattfold.llm.bpe_codec import encode_decode
from wattfold.llm.chat import chat_digests, format_chat
from wattfold.llm.chat_records import record_turns
from wattfold.llm.divergence import source_divergences
from wattfold.llm.licenses import scan_licenses
from wattfold.llm.maxent import score_documents
from wattfold.llm.minhash import near_duplicates
from wattfold.llm.oracle import SQL
from wattfold.llm.order_minhash import order_fingerprints
from wattfold.llm.packing import pack_documents
from wattfold.llm.quality import quality_verdicts
from wattfold.llm.ranked_search import ranked_search
from wattfold.llm.substring_dedup import substring_dedup
from wattfold.llm.token_counts import token_counts
from wattfold.llm.vptree import nearest_neighbours

#: Ranks of the vocabulary in byte_bpe_50k.json.
RANKS_50K = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS_MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKEN_LIMIT = 1024


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), RANKS_50K)


def op2_vp_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), lambda c: c % 20 == 0)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(_table(spark, sf_dir, "documents"), RANKS_MULTI)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(_table(spark, sf_dir, "documents"), RANKS_50K)
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    added = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"),
    )
    own = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # Each row is a record of one turn; its fingerprint selects the mapping.
    record = F.to_variant_object(F.struct("turn", "role", "text"))
    turns = record_turns(own.unionByName(added), "conv_id", record)
    return chat_digests(format_chat(turns))


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_verdicts(_table(spark, sf_dir, "documents"))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    doc_id = F.col("doc_id").cast("bigint").alias("doc_id")
    return verdicts.select(doc_id, *columns, "base_failed", "kept")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(_table(spark, sf_dir, "documents"))
    return kept.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "n_bytes",
        "n_removed",
        "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"), to_words=True)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op10_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergences(_table(spark, sf_dir, "documents"))


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_fingerprints(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = (_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return ranked_search(documents, items)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_best_fit_packing,
        op2_vp_tree_neighbours,
        op3_bpe_codec,
        op4_token_counts,
        op5_chat_format,
        op6_quality_cascade,
        op7_suffix_array_dedup,
        op8_maxent_scores,
        op9_license_scan,
        op10_minhash_hamming,
        op11_source_divergence,
        op12_order_minhash,
        op13_ranked_search,
    ]
    return {query.__name__: query for query in own}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
