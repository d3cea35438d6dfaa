"""Filtered, paged listings and lexical search of articles."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions.columns import like_pattern

LIST_COLUMNS = (
    "article_id source_id canonical_url title subtitle author category language country published_at summary sentiment duplicate_of "
    "word_count current_version extraction_method created_at"
).split()
DETAIL_COLUMNS = [*LIST_COLUMNS, "body", "content_hash", "simhash", "updated_at_source", "extraction_confidence", "url_id"]


def article_filter(
    source_id: str | None = None,
    language: str | None = None,
    q: str | None = None,
    published_after: datetime | None = None,
    published_before: datetime | None = None,
    include_duplicates: bool = False,
) -> Column:
    """The conjunction of the predicates whose argument is given. Bounds are inclusive and drop unpublished rows."""
    equal = {"source_id": source_id, "language": language}
    given = [F.col(c) == v for c, v in equal.items() if v is not None]
    given += [F.col("published_at").between(*bounds) for bounds in _bounds(published_after, published_before)]
    given += [F.col("title").ilike(like_pattern(q))] if q is not None else []
    given += [] if include_duplicates else [F.col("duplicate_of").isNull()]
    return reduce(and_, given, F.lit(True))


def _bounds(after: datetime | None, before: datetime | None) -> list[tuple[Column, Column]]:
    """At most one pair; an open end is the column itself."""
    if after is None and before is None:
        return []
    own = F.col("published_at")
    return [(own if after is None else F.lit(after), own if before is None else F.lit(before))]


def in_range(name: str, value: int, low: int, high: int) -> int:
    """``value``, if it lies in its domain."""
    if not low <= value <= high:
        raise ValueError(f"{name} is {low} to {high}")
    return value


def page_with_total(rows: DataFrame, order: list, page: int, page_size: int) -> DataFrame:
    """A page of ``rows`` with ``total``, the number of all rows, beside each; an empty page has no rows.

    The total is one aggregate joined to the page, so no window gathers all rows."""
    in_range("page_size", page_size, 1, 100)
    total = rows.agg(F.count("*").alias("total"), F.lit(1).alias("_k"))
    own = rows.orderBy(*order).offset((max(page, 1) - 1) * page_size).limit(page_size).withColumn("_k", F.lit(1))
    return own.join(F.broadcast(total), "_k").drop("_k")  # one row


def list_articles(articles: DataFrame, page: int = 1, page_size: int = 20, **filters) -> DataFrame:
    """A page of articles, newest publication first (unpublished last), then newest row, then id."""
    in_range("page", page, 1, 2**31)
    in_range("page_size", page_size, 1, 100)
    if filters.get("language") not in (None, "bn", "en"):
        raise ValueError("language is bn or en")
    order = [F.desc_nulls_last("published_at"), F.desc("created_at"), F.asc("article_id")]
    rows = articles.where(article_filter(**filters)).select(*LIST_COLUMNS)
    return rows.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def count_articles(articles: DataFrame, **filters) -> DataFrame:
    """Total of a listing: one row (total)."""
    return articles.where(article_filter(**filters)).agg(F.count("*").alias("total"))


def get_article(articles: DataFrame, article_id: int) -> DataFrame:
    """Point lookup; the predicate is pushed to the scan. No row if there is none."""
    return articles.where(F.col("article_id") == article_id).select(*DETAIL_COLUMNS).limit(1)


def lexical_search(articles: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """(article_id, title, score): title hits (1.0) before body hits (0.85) that no title hit is; newest first."""
    in_range("length of the query", len(q.strip()), 2, 500)
    pattern = like_pattern(q.strip())
    live = articles.where("duplicate_of is null").select("article_id", "title", "body", "published_at")
    in_title = F.coalesce(F.col("title").ilike(pattern), F.lit(False))
    hits = live.where(in_title | F.col("body").ilike(pattern)).withColumn("score", F.when(in_title, 1.0).otherwise(0.85))
    order = [F.desc("score"), F.desc_nulls_last("published_at"), F.asc("article_id")]
    return hits.orderBy(*order).limit(limit).select("article_id", "title", "score")
