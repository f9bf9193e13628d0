"""Five-stage preparation of a document corpus; each stage calls one operator of vellumix.llm.

A stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. All but the
last return the columns of docs. Empty tables, nulls and repeated rows pass through every
stage with the results that its operator defines for them.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumix.llm import bpe, crf, fmindex, langid, neardup
from vellumix.llm._common import checkpoint_folder, free_name, table

#: A document below this share of its main language, or without a letter, is rejected.
LEAST_LANGUAGE_SHARE = 0.5
#: A document below this probability of being good is rejected.
LEAST_QUALITY = 0.3
#: Documents at a Jaccard similarity of 0.8 or more of their five-word shingles are near duplicates (neardup.LEAST).
NEAR_SHINGLE = 5
#: Workers that served the earlier stages each keep tables of this size.
BPE_TABLE_BYTES = 40 << 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no determined language, or in none that makes up half of the text.

    A null text, or one without a letter, is in none; without a row to learn from, no document stays.
    """
    detect = langid.language_of(spark, langid.fit(langid.train_rows(docs)))
    name = free_name(docs.columns, "found")
    kept = docs.withColumn(name, detect(F.col("text")))
    keep = (F.col(f"{name}.lang_pred") != langid.UNDETERMINED) & (F.col(f"{name}.score") >= LEAST_LANGUAGE_SHARE)
    return kept.where(keep).drop(name)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the line-level field calls bad.

    A null or empty text is judged as one empty line; without labels of both kinds all documents
    have one score, so all stay or all go.
    """
    rate = crf.quality_of(spark, crf.fit(docs, table(spark, sf_dir, "labels")))
    return docs.where(rate(F.col("text")) >= LEAST_QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate class (five-word shingles, Jaccard 0.8).

    Null, empty and blank texts are one class; repeated rows are too.
    """
    return neardup.keep_one_of_each(docs, shingle=NEAR_SHINGLE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every benchmark passage out of the texts; n_chars follows the text.

    Null texts and texts without a passage stay as they are; an empty benchmark changes nothing.
    """
    return fmindex.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the remaining texts, with the digests of ids and of their decoding; a null text has no ids."""
    import public_tokenizers

    return bpe.bpe_roundtrip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True, kept_bytes=BPE_TABLE_BYTES)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("bpe_encoding", bpe_encoding),
]

#: SQL cannot express the statistical stages; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents, each written as Parquet and read again by the next.

    The written tables go under the session's shared checkpoint folder; only the last one stays.
    """
    docs = table(spark, sf_dir, "documents")
    folder = os.path.join(checkpoint_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a stage's table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
