"""The URL frontier as a table: due URLs, claims, leases, touches, and admission by token bucket."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstream.operators.upserts import update_matched

CLAIMABLE = ("queued", "retry_pending")
ACTIVE = ("leased", "crawling")


def due(now: Column) -> Column:
    """Claimable and due; a null time is never due."""
    return F.col("status").isin(*CLAIMABLE) & (F.col("next_crawl_at") <= now)


def claim(urls: DataFrame, now: Column, batch: int) -> DataFrame:
    """The ``batch`` due URLs of highest priority, the longest due first, then by id: a top-k, not a sort of all."""
    return urls.where(due(now)).orderBy(F.desc("priority"), F.asc("next_crawl_at"), F.asc("id")).limit(batch)


def budget(batch: int, most_pages: int | None, claimed: int) -> int:
    """How many URLs a job may still claim at once: its batch, or what is left of its pages."""
    return batch if most_pages is None else max(0, min(batch, most_pages - claimed))


def lease(urls: DataFrame, claimed: DataFrame, owner: str, until: Column) -> DataFrame:
    """``urls`` with the claimed ones leased to ``owner``."""
    return update_matched(
        urls, claimed.select(*urls.columns), ["id"], {"status": F.lit("leased"), "lease_owner": F.lit(owner), "next_crawl_at": until}
    )


def reap_expired(urls: DataFrame, now: Column, leased: list[str] | None = None) -> DataFrame:
    """Leases that ended before ``now`` are queued again."""
    over = F.col("status").isin(*(leased or ACTIVE)) & (F.col("lease_expires_at") < now)
    return urls.withColumn("status", F.when(over, "queued").otherwise(F.col("status")))


def touch_urls(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Known URLs take the batch's ``seen``, unknown ones are inserted; both sides have one row a URL."""
    return update_matched(state, batch, ["url"], {"seen": F.col("new_seen")})


def _run_starts(rows: DataFrame, key: str, micros: str, pause: int, span: int) -> DataFrame:
    """``rows`` with ``_run``: the time at which the row's run began. A run ends with a pause of at least ``pause`` microseconds.

    Windows run within a key's spans of ``span`` microseconds, so that a key with a third of all rows is not one task; what is carried
    from span to span is a row a span."""
    cut = rows.withColumn("_span", F.floor(F.col(micros) / span))
    w = W.partitionBy(key, "_span").orderBy(micros)
    spans = cut.groupBy(key, "_span").agg(F.min(micros).alias("_first"), F.max(micros).alias("_last"))
    over = W.partitionBy(key).orderBy("_span")  # a row a span
    spans = spans.withColumn("_opens", F.coalesce(F.col("_first") - F.lag("_last").over(over) >= pause, F.lit(True)))
    inner = cut.withColumn("_gap", F.col(micros) - F.lag(micros).over(w)).withColumn("_begin", F.when(F.col("_gap") >= pause, F.col(micros)))
    last_begin = inner.groupBy(key, "_span").agg(F.max("_begin").alias("_inner"))
    carried = spans.join(last_begin, [key, "_span"]).withColumn("_latest", F.greatest("_inner", F.when(F.col("_opens"), F.col("_first"))))
    carried = carried.withColumn("_before", F.max("_latest").over(over.rowsBetween(W.unboundedPreceding, -1)))
    start = F.when(F.col("_opens"), F.col("_first")).otherwise(F.col("_before")).alias("_start")
    here = F.max("_begin").over(w.rangeBetween(W.unboundedPreceding, 0))
    return inner.withColumn("_here", here).join(carried.select(key, "_span", start), [key, "_span"]).withColumn("_run", F.coalesce("_here", "_start"))


def token_bucket(rows: DataFrame, key: str, order: str, micros: str, rate: float, burst: float, span_s: int = 86_400) -> DataFrame:
    """(key, order, allowed, wait_s): each row asks for a token of its key's bucket, in time order; wait_s is when the next one is there.

    The bucket holds at most ``burst`` tokens and fills by ``rate`` a second. After a pause of burst / rate seconds it is full
    whatever came before, so a key's rows fall into runs that do not depend on each other: runs, not keys, are spread over
    tasks, and each task folds its sorted rows as they stream by. Rows without key or time are left out.
    """
    pause = int(burst / rate * 1e6)
    runs = _run_starts(rows.select(key, order, micros).dropna(subset=[key, micros]), key, micros, pause, span_s * 1_000_000)

    def fold(batches):
        here, tokens, last = None, burst, 0
        for batch in batches:
            keys, at, run = (batch.column(i).to_pylist() for i in (0, 2, 3))
            allowed, wait = [], []
            for k, t, r in zip(keys, at, run):
                if here != (k, r):
                    here, tokens = (k, r), burst
                else:
                    tokens = min(burst, tokens + (t - last) / 1e6 * rate)
                last = t
                allowed.append(tokens >= 1)
                wait.append(0.0 if tokens >= 1 else (1 - tokens) / rate)
                tokens -= tokens >= 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed, pa.bool_()), pa.array(wait, pa.float64())], [key, order, "allowed", "wait_s"])

    spread = runs.select(key, order, micros, "_run").repartition(key, "_run").sortWithinPartitions(key, "_run", micros, order)
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in (key, order)]
    return spread.mapInArrow(fold, f"{', '.join(kinds)}, allowed boolean, wait_s double")


def bucket_ttl(rate: float, burst: float) -> int:
    """Seconds after which the state of an idle bucket may be dropped: it is full again, and a minute has passed."""
    return math.ceil(burst / rate) + 60
