"""Sinks: month-partitioned logs, raw pages under deterministic keys, messages, dated snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.functions.columns import raw_key


def append_by_month(rows: DataFrame, path: str, at: str) -> None:
    """Append to a log partitioned by the month of ``at``; rows without a time go to a partition of their own."""
    rows.withColumn("month", F.coalesce(F.date_format(at, "yyyy-MM"), F.lit("none"))).write.mode("append").partitionBy("month").parquet(path)


def raw_pages(pages: DataFrame) -> DataFrame:
    """Pages to keep: article pages with a body, with their storage key; unmodified ones and other kinds are left out."""
    kept = pages.where("url_type = 'article' and not not_modified and raw_html is not null")
    return kept.withColumn("key", raw_key(F.col("source_slug"), F.col("fetched_at"), F.col("url_id")))


def write_raw_pages(pages: DataFrame, path: str) -> None:
    kept = raw_pages(pages).select("key", "raw_html", F.col("source_slug").alias("source"), F.to_date("fetched_at").alias("date"))
    kept.write.mode("append").partitionBy("source", "date").parquet(path)


def messages(rows: DataFrame, kind: str) -> DataFrame:
    """(kind, payload, attempt): each row as a JSON message."""
    return rows.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*rows.columns)).alias("payload"), F.lit(1).alias("attempt"))


def fan_out(paths: dict[str, str]):
    """A foreachBatch function that writes each message of a micro-batch to the folder of every kind in ``paths``.

    The folder of a batch is named by its id and overwritten, so a repeated batch leaves the same files.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        for kind, path in paths.items():
            messages(batch, kind).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def snapshot(rows: DataFrame, path: str, date: str) -> None:
    """A full copy of a table under its date."""
    rows.write.mode("overwrite").parquet(f"{path}/date={date}")
