"""Queries of problem 5 (near-duplicate records with small edits)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.llm.near import Similarity, class_links, connected_groups, similar_classes, similar_pairs
from inkstream.session import materialize
from inkstream.sources.tables import read_table

NEWS = Similarity(width=3, threshold=0.6)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of articles with similarity of at least 0.6: (article_id_a, article_id_b)."""
    docs = read_table(spark, sf_dir, "articles").select("article_id", "title", "body")
    pairs = similar_pairs(docs, NEWS)
    return pairs.select(F.col("a").alias("article_id_a"), F.col("b").alias("article_id_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article with words enough for a shingle and its group of linked articles: (article_id, group_id)."""
    docs = read_table(spark, sf_dir, "articles").select("article_id", "title", "body")
    members, links = similar_classes(docs, NEWS)
    return connected_groups(members, materialize(links, "links")).select(F.col("id").alias("article_id"), F.col("group").alias("group_id"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article with its class of exact copies, the number of the other copies, and the number of articles of other
    classes it is similar to: (article_id, class_id, copies, links)."""
    docs = read_table(spark, sf_dir, "articles").select("article_id", "title", "body")
    members, links = similar_classes(docs, NEWS)
    found = class_links(members, materialize(links, "links"))
    return found.select(F.col("id").alias("article_id"), F.col("class").alias("class_id"), "copies", "links")


QUERIES = {"p5_found": p5_found, "p5_classes": p5_classes, "p5_groups": p5_groups}
SQL: dict[str, str] = {}
