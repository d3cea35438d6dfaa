"""Queries of problem 10 (abusive, hateful or sexual content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkstream.llm.screen import Screen, ScreenFit, categories, fit_screen, labelled_texts, rates, score_documents
from inkstream.session import materialize
from inkstream.sources.tables import read_table


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Screen]:
    fit = ScreenFit()
    docs = read_table(spark, sf_dir, "documents")
    screen = fit_screen(labelled_texts(docs, read_table(spark, sf_dir, "labels"), fit), fit)
    return docs, score_documents(docs.select("doc_id", "text"), screen, fit), screen


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and each category it falls in: (doc_id, category)."""
    _, scores, screen = _scored(spark, sf_dir)
    return categories(scores, screen).selectExpr("id AS doc_id", "category")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its score for each category: (doc_id, abusive, hateful, sexual)."""
    return _scored(spark, sf_dir)[1].withColumnRenamed("id", "doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of documents in each category by source."""
    docs, scores, screen = _scored(spark, sf_dir)
    return rates(materialize(categories(scores, screen), "screened"), docs.select("doc_id", "source"))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}
SQL: dict[str, str] = {}
