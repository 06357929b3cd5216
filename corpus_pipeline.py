"""From raw documents to packed sequences: quality, near duplicates, benchmark leaks, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, ngram_join, packing, pii, quality
from tidewater.llm.common import bounded_batches, drop_tables, read_spread, table_mark, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality discriminant, learned from the labels outside the held-out fold, doesn't reject."""
    bounded_batches(spark)
    model = quality.fit(docs, quality.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.where(quality.score_column(spark, model) >= quality.CUT)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest doc_id; of rows that repeat an id and its
    text one stays, rows without an id all stay. Rows that repeat an id with different texts are judged by their texts."""
    bounded_batches(spark)
    text = F.xxhash64("text")
    versions = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(text).alias("a"), F.max(text).alias("b"))
    again = written(versions.where("rows > 1"))
    if again.where("a <> b").isEmpty():
        gone = ngram_join.ngram_jaccard_join(docs).where("not kept").select("doc_id")
        kept = docs.join(gone, "doc_id", "left_anti")
    else:
        keyed = docs.withColumn("key_", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
        classes = ngram_join.ngram_jaccard_join(keyed, id_col="key_").select(F.col("doc_id").alias("key_"), "class_id")
        classes = classes.join(keyed.select("key_", "doc_id").distinct(), "key_")
        first = classes.groupBy("class_id").agg(F.min(F.struct("doc_id", "key_")).alias("f")).select(F.col("f.key_").alias("key_"))
        kept = keyed.join(classes.join(first, "key_", "left_anti").select("key_"), "key_", "left_anti").drop("key_")
    if again.isEmpty():
        return kept
    repeated = kept.withColumn("version_", text)
    once = repeated.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "version_"])
    return repeated.join(again, "doc_id", "left_anti").unionByName(once).drop("version_")


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    bounded_batches(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by its kind; n_chars is that of the new text."""
    bounded_batches(spark)
    masked = docs.withColumn("text", pii.mask_column(spark, pii.fit(docs)))
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document's pieces with their token ids, laid out in sequences."""
    bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", keep_unleaked),
    ("personal data", mask_personal_data),
    ("packing", pack_sequences),
]

#: Learned scores, alignments and tokens are beyond SQL; tests/llm holds brute-force versions against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table, each on what the one before it wrote. A stage's own tables go once
    its result is written, its input too."""
    docs, mark = read_spread(spark, f"{sf_dir}/documents.parquet"), table_mark()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
            drop_tables(spark, mark)
    return docs
