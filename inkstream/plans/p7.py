"""Queries of problem 7 (mixed timestamp formats and time zones)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkstream.operators.instants import extend_dictionary, normalise_instants, page_times
from inkstream.session import materialize
from inkstream.sources.tables import read_table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each published_at or updated_at that denotes an instant: (page_id, field_name, epoch_s)."""
    t = {n: read_table(spark, sf_dir, n) for n in ("extracted_articles", "pages", "sources", "source_locales")}
    rows = page_times(t["extracted_articles"], t["pages"], t["sources"], t["source_locales"])
    dictionary = materialize(extend_dictionary(rows), "instants")
    found = normalise_instants(rows, dictionary).where("epoch_s is not null")
    return found.select("page_id", "field_name", "epoch_s").distinct()


QUERIES = {"p7_found": p7_found}
SQL: dict[str, str] = {}
