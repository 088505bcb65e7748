"""Cleaning a corpus for training: five stages, each written as Parquet and read again.

1. quality rules: failing lines go, then documents that fail or lose too much text
2. near duplicates: SimHash classes are compared exactly, and what minimum hashes add to them;
   one document of each class of texts that share 0.8 of their five-word shingles stays
3. benchmark decontamination: documents that match a benchmark item go
4. personal data: every span is replaced by its kind
5. packing: the documents' ids in windows of at most 4096 tokens

Null texts have no words and go in the first stage; rows with a null key pass as told in
the operators' modules; empty tables pass as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querysentry.llm import decontaminate, line_rules, near_copies, packing, pii, simhash
from querysentry.llm.frames import store, table
from querysentry.llm.queries import model_path

#: Words that a worker remembers in a stage: one executor's workers of several stages share its memory.
WORDS = 150_000
#: Fingerprints of one bucket that are compared inside one task; larger buckets are linked through points.
MAX_BUCKET = 4_096


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_rules.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prints = simhash.near_duplicates(near_copies.text_hashes(docs), radius=4, words=4, key="text_hash", max_bucket=MAX_BUCKET)
    classes = prints.select(F.col("doc_id").alias("text_hash"), F.col("component_id").alias("class"))
    return near_copies.keep_first(docs, words=5, similarity=0.8, classes=classes)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), memory=WORDS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_spans(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids: doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32, ids."""
    return packing.pack_documents(docs, model_path("word_bpe_49k.json"), end_id=2, memory=WORDS)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("packing", pack),
]

#: The tokenizer and the fingerprints are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
