"""Documents to packed training sequences: quality rules, near-duplicates, repeated
passages, packing. Each stage's rows are written and read again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattfold.llm.common import stored
from wattfold.llm.minhash import near_duplicates
from wattfold.llm.packing import pack_documents
from wattfold.llm.quality import COMPRESSION, RULES, quality_verdicts
from wattfold.llm.substring_dedup import substring_dedup
from wattfold.scratch import own_scratch, scratch_dir

#: Words of a shingle in the near-duplicate stage.
SHINGLE_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    found = quality_verdicts(docs, (*RULES, COMPRESSION), measured=False)
    return found.where("kept").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id.

    Every row is judged by its own text: rows that share a doc_id, or have none, are
    documents of their own. So only rows that are linked with a row that stays, or with one
    that leads there, go; exact repeats are. In a group a missing doc_id comes last, and
    rows of one id go by where they are read. Texts without words are linked with nothing.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("key"), F.struct(*docs.columns).alias("row")
    )
    rows = stored(rows)
    texts = rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))
    found = near_duplicates(texts, width=SHINGLE_WORDS)
    found = stored(found.select(F.col("doc_id").alias("key"), "component_id"))
    # A group's rows but for the representative; only groups of two and more have such.
    linked = found.where("key != component_id")
    first = linked.select("component_id").distinct()
    linked = linked.union(first.select(F.col("component_id").alias("key"), "component_id"))
    ids = rows.select("key", F.col("row.doc_id").alias("doc_id"))
    linked = stored(linked.join(ids, "key"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    kept = linked.groupBy("component_id").agg(F.min_by("key", order).alias("key")).select("key")
    dropped = linked.select("key").join(kept, "key", "left_anti")
    return rows.join(dropped, "key", "left_anti").select("row.*")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur earlier.

    Of a character whose bytes were cut apart nothing stays. ``n_chars`` follows.
    """
    kept = substring_dedup(docs, as_text=True)
    kept = kept.withColumns({"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")})
    return kept.select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in packed sequences."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the local search of the packing nor the dedup's components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder.

    A stage's scratch goes when its rows are written, and they go when the next one's are.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = scratch_dir(spark)
        with own_scratch(spark):
            out = stage(spark, docs, sf_dir)
            schema = out.schema
            out.write.parquet(path)
        docs = spark.read.schema(schema).parquet(path)
        if before:
            gone = spark._jvm.org.apache.hadoop.fs.Path(before)
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
