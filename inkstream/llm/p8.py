"""Queries of problem 8 (evaluation texts leaking into training text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkstream.llm.leak import PhraseSearch, PositionIndex
from inkstream.session import scratch_path
from inkstream.sources.tables import read_table


def _search(spark: SparkSession, sf_dir: str, p: PhraseSearch) -> DataFrame:
    index = PositionIndex(spark, scratch_path(spark, "positions")).add(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return index.search(read_table(spark, sf_dir, "eval_items").select("item_id", "text"), p)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and test item that share at least 10 consecutive words: (doc_id, item_id)."""
    return _search(spark, sf_dir, PhraseSearch()).select("doc_id", "item_id")


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and test item with a run of 10 words of the item whose words stand within 2 places of theirs:
    (doc_id, item_id, matches)."""
    return _search(spark, sf_dir, PhraseSearch(slop=2))


QUERIES = {"p8_found": p8_found, "p8_near": p8_near}
_RUNS = """(SELECT DISTINCT {0}, array_to_string(w[i:i + 9], ' ') AS run FROM (SELECT {0}, w, unnest(generate_series(1, len(w) - 9)) AS i
      FROM (SELECT {0}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\x{{200d}}]+') AS w FROM {1} WHERE text IS NOT NULL)))"""
SQL: dict[str, str] = {
    "p8_found": f"SELECT DISTINCT doc_id, item_id FROM {_RUNS.format('doc_id', 'documents')} JOIN {_RUNS.format('item_id', 'eval_items')} USING (run)"
}
