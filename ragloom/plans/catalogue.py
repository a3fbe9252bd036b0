"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import answer_queries, retrieval_queries, source_queries, survey_queries, text_queries  # noqa: F401  register their queries
from .registry import QUERIES, SQL


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["hybrid_flagship"](spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
