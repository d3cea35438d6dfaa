"""Queries of problem 1 (page boilerplate mixed with main content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.llm.boilerplate import CutFit, fit_classifier, page_bodies, sample_pages
from inkstream.llm.lines import SPACES
from inkstream.session import materialize
from inkstream.sources.tables import read_table


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").where("url_type = 'article' and http_status = 200 and raw_html is not null")
    return pages.select("page_id", F.col("source_slug").alias("source"), F.col("raw_html").alias("page"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct paragraph or subheading of an article's own body: (page_id, field_name, para_md5).

    Pages are cut by their markup. A line of an extracted body belongs to the article if the cut of its page found it
    as a paragraph; a record without its page gives no rows.
    """
    pages = _articles(spark, sf_dir)
    extracted = read_table(spark, sf_dir, "extracted_articles").select("page_id", "body")
    fit = CutFit()
    classifier = fit_classifier(sample_pages(pages, extracted, fit), fit)
    cut = page_bodies(pages.select("page_id", "page"), classifier)
    found = cut.select("page_id", F.explode("paragraphs").alias("text")).select("page_id", F.md5(F.col("text").cast("binary")).alias("para_md5"))
    found = materialize(found.distinct(), "bodies")
    lines = extracted.select("page_id", F.explode(F.split("body", "\n")).alias("line"))
    text = F.trim(F.regexp_replace("line", SPACES, " "))
    own = lines.select("page_id", F.md5(text.cast("binary")).alias("para_md5")).join(found, ["page_id", "para_md5"], "left_semi").distinct()
    sides = [x.select("page_id", F.lit(n).alias("field_name"), "para_md5") for n, x in (("raw_html", found), ("body", own))]
    return sides[0].unionByName(sides[1])


def p1_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of each article page: (page_id, body), paragraphs parted by a blank line."""
    pages = _articles(spark, sf_dir)
    extracted = read_table(spark, sf_dir, "extracted_articles").select("page_id", "body")
    fit = CutFit()
    classifier = fit_classifier(sample_pages(pages, extracted, fit), fit)
    cut = page_bodies(pages.select("page_id", "page"), classifier)
    return cut.select("page_id", F.array_join("paragraphs", "\n\n").alias("body")).distinct()


QUERIES = {"p1_found": p1_found, "p1_bodies": p1_bodies}
SQL: dict[str, str] = {}
