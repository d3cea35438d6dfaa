"""Operational aggregates: counts, series, buckets, percentiles, source health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstream.functions.columns import epoch_s


def count_by(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def beside(*single: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    keyed = [x.withColumn("_k", F.lit(1)) for x in single]
    return reduce(lambda a, b: a.join(b, "_k"), keyed).drop("_k")


def daily(rows: DataFrame, at: str, keys: list[str], *measures: Column) -> DataFrame:
    """Measures by UTC day (yyyy-MM-dd) and keys."""
    return rows.groupBy(F.date_format(at, "yyyy-MM-dd").alias("day"), *keys).agg(*measures)


def rates(rows: DataFrame, at: str, keys: list[str], seconds: int) -> DataFrame:
    """(start_s, keys, rate): events a second in tumbling windows."""
    w = F.window(at, f"{seconds} seconds")
    counts = rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counts.select(epoch_s(F.col("w.start")).alias("start_s"), *keys, F.round(F.col("n") / float(seconds), 6).alias("rate"))


def top_k(links: DataFrame, names: DataFrame, key: str, k: int) -> DataFrame:
    """(name, articles): the k names with most links, ties by name. Links are counted by key before the join."""
    counts = links.groupBy(key).agg(F.count("*").alias("n")).join(names, key)
    return counts.groupBy("name").agg(F.sum("n").alias("articles")).orderBy(F.desc("articles"), "name").limit(k)


def buckets(rows: DataFrame, column: str, known: list[str], rest: str, name: str) -> DataFrame:
    """(place, bucket, count) of a label in a fixed order, zero where none; unknown labels and null fall into ``rest``."""
    label = F.lower(F.trim(column))
    counts = rows.groupBy(F.when(label.isin(*known), label).otherwise(rest).alias("bucket")).agg(F.count("*").alias("n"))
    frame = rows.sparkSession.createDataFrame([(i, b) for i, b in enumerate([*known, rest], 1)], "place int, bucket string")
    return frame.join(counts, "bucket", "left").select("place", "bucket", F.coalesce("n", F.lit(0)).alias(name))


def percentiles(rows: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """(key, p95, n): exact percentile by key."""
    name = f"p{round(share * 100)}"
    return rows.groupBy(key).agg(F.round(F.percentile(value, share), 6).alias(name), F.count("*").alias("n"))


def histogram(rows: DataFrame, key: str, value: str, edges: list[int]) -> DataFrame:
    """(key, le, n): cumulative histogram; one pass, one partial aggregate an edge."""
    counts = [F.count_if(F.col(value) <= e).alias(f"_{e}") for e in edges]
    wide = rows.where(F.col(value).isNotNull()).groupBy(key).agg(*counts)
    cells = F.array(*[F.struct(F.lit(e).alias("le"), F.col(f"_{e}").alias("n")) for e in edges])
    return wide.select(key, F.explode(cells).alias("x")).select(key, "x.le", "x.n")


def histogram_quantile(cells: DataFrame, key: str, share: float) -> DataFrame:
    """(key, quantile) from cumulative buckets (key, le, n): linear within the bucket that holds it, from 0 on.

    What lies beyond the last edge gives the last edge; a key without values gives null. Bounded by the edges, whatever the number
    of values; the error is at most the width of the bucket.
    """
    order = F.array_sort(F.collect_list(F.struct("le", "n")))  # a row an edge
    wide = cells.groupBy(key).agg(order.alias("_cells"), F.max("n").alias("_total")).withColumn("_rank", F.col("_total") * share)
    at = F.aggregate("_cells", F.lit(0), lambda k, x: F.when(x["n"] < F.col("_rank"), k + 1).otherwise(k))
    placed = wide.withColumn("_k", F.least(at, F.size("_cells") - 1)).withColumn("_here", F.element_at("_cells", F.col("_k") + 1))
    before = F.when(F.col("_k") > 0, F.get("_cells", F.col("_k") - 1))
    low, under = F.coalesce(before["le"], F.lit(0)), F.coalesce(before["n"], F.lit(0))
    le, inside = F.col("_here.le"), F.col("_here.n") - under
    value = F.when(inside <= 0, le.cast("double")).otherwise(low + (le - low) * F.least((F.col("_rank") - under) / inside, F.lit(1.0)))
    return placed.select(key, F.when(F.col("_total") > 0, F.round(value, 6)).alias("quantile"))


def zero_filled(counts: DataFrame, key: str, count: str, known: list[str]) -> DataFrame:
    """``counts`` (key, count) of the ``known`` keys, 0 where there is none."""
    frame = counts.sparkSession.createDataFrame([(k,) for k in known], f"{key} string")
    return frame.join(counts, key, "left").select(key, F.coalesce(count, F.lit(0)).alias(count))


def exposition(metrics: DataFrame) -> DataFrame:
    """(line) in the text form that scrapers read, of ``metrics`` (name, labels map<string,string>, value): labels in name order, quotes,
    backslashes and line breaks escaped; a null value is left out."""
    text = F.col("value").cast("string")
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.transform(F.array_sort(F.map_entries(F.coalesce("labels", F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit('="'), escaped(F.coalesce(e["value"], F.lit(""))), F.lit('"')))
    labels = F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return metrics.where("name is not null and value is not null").select(F.concat("name", labels, F.lit(" "), text).alias("line"))


def labelled_sum(gauge: DataFrame, label: str, value: str, pattern: str) -> DataFrame:
    """(total) of the values whose label matches ``pattern`` as a whole."""
    return gauge.where(F.col(label).rlike(f"^(?:{pattern})$")).agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"))


def source_health(sources: DataFrame, articles: DataFrame, urls: DataFrame) -> DataFrame:
    """By source: articles, time of the last one, and pending, fetched and failed URLs; zero where there are none."""
    a = articles.groupBy("source_id").agg(F.count("*").alias("n"), F.max("created_at").alias("last"))
    status = F.col("status")
    u = urls.groupBy("source_id").agg(
        F.count_if(status.isin("queued", "retry_pending")).alias("pending"),
        F.count_if(status == "success").alias("success"),
        F.count_if(status.isin("failed", "blocked")).alias("failed"),
    )
    s = sources.select(F.col("id").alias("source_id"), "slug").join(a, "source_id", "left").join(u, "source_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("pending", "success", "failed")]
    return s.select("slug", F.coalesce("n", F.lit(0)).alias("articles"), epoch_s(F.col("last")).alias("last_s"), *zero)


def fair_order(sources: DataFrame, articles: DataFrame, due: DataFrame) -> DataFrame:
    """(slug, place): sources in the order they are served (a row a source, so one task ranks them)."""
    a = articles.groupBy("source_id").agg(F.count("*").alias("n"))
    q = due.groupBy("source_id").agg(F.count_if(F.col("url_type") != "article").alias("hubs"), F.count("*").alias("due"))
    s = sources.select(F.col("id").alias("source_id"), "slug").join(a, "source_id", "left").join(q, "source_id", "left").na.fill(0, ["n", "hubs", "due"])
    return s.select("slug", F.row_number().over(W.orderBy("n", F.desc("hubs"), F.desc("due"), "slug")).alias("place"))
