"""Corpus preparation: classify, drop near-duplicates, cut repeated passages, redact, pack.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``; ``n_chars`` follows changed texts.

Defined cases: rows without ``doc_id`` are scored, cut and redacted like others; they can't be named, so the near-duplicate
stage keeps them all, and they are packed under a null ``doc_id``. Of rows that repeat a ``doc_id`` and its text the near-duplicate
stage keeps one. Null texts are empty. Extra columns pass through all stages but the last, which returns its own. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragloom.llm import packing, personal_data, quality_classifier, simhash, substrings
from ragloom.llm.common import materialize

#: Fingerprints at so many differing bits are linked: one more than the stand-alone query's, the most that two segments find.
MAX_BITS = 5
#: Bytes of a passage: 51 words of five bytes each with its space. The stand-alone query's 400 bytes are about 65 words.
PASSAGE_SPAN = 256


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier rejects go."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.representatives(docs, MAX_BITS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that occur twice go."""
    return substrings.clean(docs, PASSAGE_SPAN)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced."""
    return personal_data.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become token sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", classify),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeated_passages),
    ("PII", redact),
    ("best-fit packing", pack),
]

#: SQL can't express the stages; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
