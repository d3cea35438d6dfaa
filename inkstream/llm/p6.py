"""Queries of problem 6 (visually identical text with different characters)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkstream.llm.text import variant_fields
from inkstream.sources.tables import read_table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each title or body of articles that its usual form writes otherwise: (article_id, field_name)."""
    return variant_fields(read_table(spark, sf_dir, "articles"), "article_id", ["title", "body"]).distinct()


QUERIES = {"p6_found": p6_found}
SQL: dict[str, str] = {}
