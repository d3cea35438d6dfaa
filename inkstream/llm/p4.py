"""Queries of problem 4 (lines repeated across one site's documents)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.llm.lines import repeated_lines, without_repeated_lines
from inkstream.sources.tables import read_table


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(doc, body) of extracted_articles and (doc, source) of pages; a page delivered twice counts once."""
    pages = read_table(spark, sf_dir, "pages").where("source_slug is not null")
    origins = pages.groupBy(F.col("page_id").alias("doc")).agg(F.min("source_slug").alias("source"))
    return read_table(spark, sf_dir, "extracted_articles").select(F.col("page_id").alias("doc"), "body"), origins


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a body that is frequent in its source: (page_id, line_no)."""
    return repeated_lines(*_inputs(spark, sf_dir)).select(F.col("doc").alias("page_id"), "line_no")


def p4_clean_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies rebuilt without frequent lines: (page_id, clean_body)."""
    bodies, origins = _inputs(spark, sf_dir)
    return without_repeated_lines(bodies.where("body is not null"), origins).select(F.col("doc").alias("page_id"), "clean_body")


_KEYED = r"""
WITH origin AS (
  SELECT page_id, min(source_slug) AS source FROM pages WHERE source_slug IS NOT NULL GROUP BY page_id
), rec AS (
  SELECT e.page_id, o.source, string_split(e.body, chr(10)) AS ls FROM extracted_articles e JOIN origin o USING (page_id)
  WHERE e.body IS NOT NULL
), lines AS (
  SELECT page_id, source, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS raw FROM rec
), keyed AS (
  SELECT page_id, source, line_no, raw, regexp_replace(trim(regexp_replace(lower(raw),
    '[\t\x0b-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')),
    '\p{Nd}+', '#', 'g') AS k
  FROM lines
), total AS (
  SELECT source, count(DISTINCT page_id) AS n FROM rec GROUP BY source
), frequent AS (
  SELECT source, k FROM keyed JOIN total USING (source) WHERE k <> '' GROUP BY source, k, n
  HAVING count(DISTINCT page_id) >= 3 AND count(DISTINCT page_id) >= n * 0.02 - 1e-9
)
"""
SQL = {
    "p4_found": _KEYED + "SELECT page_id, line_no::INT AS line_no FROM keyed SEMI JOIN frequent USING (source, k)",
    "p4_clean_bodies": _KEYED
    + """SELECT page_id, coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (WHERE f.k IS NULL), '') AS clean_body
         FROM keyed q LEFT JOIN frequent f USING (source, k) GROUP BY page_id""",
}
QUERIES = {"p4_found": p4_found, "p4_clean_bodies": p4_clean_bodies}
