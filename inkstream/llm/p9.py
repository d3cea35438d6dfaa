"""Queries of problem 9 (mixing sources to target weights)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkstream.llm.mixing import Mixing, mix
from inkstream.sources.tables import read_table


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, read_table(spark, sf_dir, "mix_targets"), Mixing())


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix, one row per use of a record and block: (slot, source, start, doc_id, copy, offset, tokens), in order of (slot, start)."""
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mixed(spark, sf_dir)[1]


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
