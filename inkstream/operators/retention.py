"""Retention as set operations: purge batches, cycle records, storage deletes in chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.operators.extraction import numbered


def purge_batches(rows: DataFrame, key: str, at: str, cutoff: Column, size: int = 200, most: int = 500) -> DataFrame:
    """(key, at, batch) of the rows older than ``cutoff``: oldest first, ``size`` a batch, numbered from 1, at most ``most`` batches a cycle.

    What is over stays for the next cycle. Ties go by key; rows without a time are never purged."""
    old = numbered(rows.where(F.col(at) < cutoff).select(at, key), [at, key])
    return old.select(key, at, F.floor((F.col("_n") - 1) / size + 1).cast("long").alias("batch")).where(F.col("batch") <= most)


def cycle_records(events: DataFrame, cycle: str, at: str) -> DataFrame:
    """(cycle, started_s, finished_s, duration_s, n) of each cycle that has a name; a duration is never below 0."""
    spans = events.where(F.col(cycle).isNotNull()).groupBy(cycle).agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("n"))
    seconds = F.greatest(F.lit(0.0), (F.unix_micros("b") - F.unix_micros("a")) / 1e6)
    return spans.select(cycle, F.floor(F.unix_micros("a") / 1_000_000).alias("started_s"), F.floor(F.unix_micros("b") / 1_000_000).alias("finished_s"), seconds.alias("duration_s"), "n")


def purge_counts(victims: DataFrame, at: str, keys: list[str]) -> DataFrame:
    """(day, key, value, n): purged rows by day, for each of ``keys`` and its values (null as 'none'); added to what is recorded by an
    additive upsert. One pass over the victims."""
    cells = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.col(k).cast("string"), F.lit("none")).alias("value")) for k in keys])
    rows = victims.select(F.date_format(at, "yyyy-MM-dd").alias("day"), F.explode(cells).alias("x"))
    return rows.groupBy("day", "x.key", "x.value").agg(F.count("*").alias("n"))


def recent(cycles: DataFrame, at: str, key: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the latest rows, ties by key."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit is 1 to 200, offset 0 or more")
    return cycles.orderBy(F.desc_nulls_last(at), key).offset(offset).limit(limit)


def blob_address(location: Column, bucket: str) -> Column:
    """(bucket, key) of s3://bucket/key, of http(s)://host/bucket/key, or of a bare key in ``bucket``; null fields for blank ones."""
    text = F.nullif(F.trim(location), F.lit(""))
    s3, web = r"^s3://([^/]+)/(.+)$", r"^https?://[^/]+/([^/]+)/([^?#]+)"
    bare = ~text.rlike("^[a-z0-9]+://")
    pick = lambda k, plain: F.when(text.rlike(s3), F.regexp_extract(text, s3, k)).when(text.rlike(web), F.regexp_extract(text, web, k)).when(bare, plain)
    return F.struct(pick(1, F.lit(bucket)).alias("bucket"), pick(2, F.regexp_replace(text, "^/+", "")).alias("key"))


def delete_chunks(blobs: DataFrame, size: int = 1000) -> DataFrame:
    """(bucket, key, chunk) of ``blobs`` (bucket, key): each blob once, ``size`` a delete request, numbered from 1 in each bucket by key."""
    ranked = numbered(blobs.dropna(subset=["bucket", "key"]).select("bucket", "key").distinct(), ["bucket", "key"])
    first = ranked.groupBy("bucket").agg(F.min("_n").alias("_first"))
    return ranked.join(first, "bucket").select("bucket", "key", F.floor((F.col("_n") - F.col("_first")) / size + 1).cast("long").alias("chunk"))


def untracked(created: Column, live: Column, tracked: Column) -> Column:
    """Rows that were made and are neither there nor counted as purged."""
    return F.greatest(F.lit(0), created - live - tracked)


def interval_seconds(minutes: float | None, hours: float | None = None) -> float:
    """Seconds between cycles, at least a minute; the older setting in hours counts where minutes are not given."""
    return max(60.0, minutes * 60 if minutes is not None else (hours or 0) * 3600)
