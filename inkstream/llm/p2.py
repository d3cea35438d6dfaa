"""Queries of problem 2 (missing or wrong document language labels)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstream.llm.language import Fit, fit_models, identify, labelled_sample, language_code
from inkstream.session import materialize
from inkstream.sources.tables import read_table


def article_languages(spark: SparkSession, sf_dir: str, fit: Fit = Fit()) -> DataFrame:
    """(article_id, source_id, label, lang, confidence, segments) of every article; label is the code it came with."""
    articles = read_table(spark, sf_dir, "articles")
    models = fit_models(labelled_sample(articles.select("article_id", "language", "body"), fit), fit)
    found = identify(articles.select(F.struct("article_id", "source_id", "language").alias("id"), "body"), models, fit)
    return found.select("id.article_id", "id.source_id", language_code(F.col("id.language")).alias("label"), "lang", "confidence", "segments")


def p2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article with its language, the confidence, and the label it came with."""
    return article_languages(spark, sf_dir).select("article_id", "label", "lang", "confidence", F.size("segments").alias("foreign_paragraphs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and sources whose label is missing or wrong, and foreign paragraphs:
    (record_kind, record_key, para_no, lang)."""
    found = materialize(article_languages(spark, sf_dir).drop("confidence"), "languages")
    wrong = F.col("lang").isNotNull() & ~F.col("label").eqNullSafe(F.col("lang"))
    key = F.col("article_id").cast("string").alias("record_key")
    articles = found.where(wrong).select(F.lit("article").alias("record_kind"), key, F.lit(0).alias("para_no"), "lang")
    segments = found.select(key, F.explode("segments").alias("s")).select(F.lit("segment").alias("record_kind"), "record_key", "s.para_no", "s.lang")
    counts = found.where("lang is not null and source_id is not null").groupBy("source_id", "lang").agg(F.count("*").alias("n"))
    order = W.partitionBy("source_id").orderBy(F.desc("n"), "lang")  # a row per source and language
    most = counts.withColumn("k", F.row_number().over(order)).where("k = 1").select("source_id", "lang")
    sources = read_table(spark, sf_dir, "sources").select(F.col("id").alias("source_id"), "slug", language_code(F.col("language")).alias("label"))
    sources = sources.join(most, "source_id").where(wrong)
    sources = sources.select(F.lit("source").alias("record_kind"), F.col("slug").alias("record_key"), F.lit(0).alias("para_no"), "lang")
    return articles.unionByName(segments).unionByName(sources)


QUERIES = {"p2_found": p2_found, "p2_languages": p2_languages}
SQL: dict[str, str] = {}
