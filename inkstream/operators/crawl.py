"""Crawl-side relations: sources, links, failures, blocked requests, the state of a URL folded from its attempts."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds of resources, and parts of addresses, that a page's rendering does without.
BLOCKED_KINDS = ("image", "media", "font")
BLOCKED_PARTS = (
    "doubleclick.net googlesyndication.com googleadservices.com google-analytics.com googletagmanager.com googletagservices.com "
    "adsafeprotected.com amazon-adsystem.com facebook.net facebook.com/tr adnxs.com taboola.com outbrain.com criteo.com criteo.net "
    "scorecardresearch.com chartbeat.com hotjar.com quantserve.com pubmatic.com rubiconproject.com moatads.com onesignal.com"
).split()


def blocked(kind: Column, url: Column) -> Column:
    """Whether a request is left out: by its kind, or by a part of its address. Null counts as harmless."""
    listed = F.exists(F.array(*[F.lit(x) for x in BLOCKED_PARTS]), lambda part: F.contains(url, part))
    return F.coalesce(kind.isin(*BLOCKED_KINDS), F.lit(False)) | F.coalesce(listed, F.lit(False))


def sources_to_crawl(sources: DataFrame, slug: str | None = None) -> DataFrame:
    """The source named by ``slug``, switched on or not; without one, those that are enabled and may be crawled."""
    return sources.where(F.col("enabled") & F.col("crawl_enabled") if slug is None else F.col("slug") == slug)


def valid_source(slug: Column, base_url: Column) -> Column:
    """Whether a slug is of lower-case letters, digits and dashes and the address is http or https."""
    return F.coalesce(slug.rlike("^[a-z0-9-]+$") & base_url.rlike("^https?://"), F.lit(False))


def insert_sources(sources: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources with the new ones, verdicts (slug, verdict)) for ``new`` (slug, base_url and others).

    verdict: invalid (form of slug or address), conflict (a source has the slug already), or inserted; addresses lose trailing slashes.
    Of several new rows with one slug the one with the smallest address counts.
    """
    known = sources.select("slug", F.lit(True).alias("_known"))
    judged = new.groupBy("slug").agg(F.min_by(F.struct(*new.columns), "base_url").alias("x")).select("x.*").join(known, "slug", "left")
    fine = valid_source(F.col("slug"), F.col("base_url"))
    judged = judged.withColumn("verdict", F.when(~fine, "invalid").when(F.col("_known"), "conflict").otherwise("inserted"))
    rows = judged.where("verdict = 'inserted'").withColumn("base_url", F.regexp_replace("base_url", "/+$", ""))
    return sources.unionByName(rows.select(*new.columns), allowMissingColumns=True), judged.select("slug", "verdict")


def patch(rows: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns that ``patches`` (key and some of the columns) gives; null leaves a value as it is."""
    given = [c for c in patches.columns if c != key]
    named = patches.select(key, *[F.col(c).alias(f"_new_{c}") for c in given])
    joined = rows.join(named, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in given else F.col(c) for c in rows.columns])


@F.pandas_udf(T.StringType())
def absolute_url(base: pd.Series, link: pd.Series) -> pd.Series:
    def join(b, x):
        try:
            return urljoin(b or "", x) if x else None
        except ValueError:
            return None

    return pd.Series([join(b, x) for b, x in zip(base, link)], dtype=object)


def article_links(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(page_id, link, place) of a section page's links: absolute, each once a page at its first place, those alone that match an
    article pattern of the source from the start. ``pages``: (page_id, source_slug, url, html)."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'#]+)["']"""), F.lit(1))
    links = pages.select("page_id", "source_slug", "url", F.posexplode(found).alias("place", "href"))
    whole = links.withColumn("link", absolute_url("url", "href")).groupBy("page_id", "source_slug", "link").agg(F.min("place").alias("place"))
    patterns = sources.select(F.col("slug").alias("source_slug"), "article_url_patterns")
    fits = F.exists("article_url_patterns", lambda p: F.regexp_like(F.col("link"), F.concat(F.lit("^(?:"), p, F.lit(")"))))
    return whole.join(patterns, "source_slug").where(fits).select("page_id", "link", "place")


def failure_category(status: Column, error: Column) -> Column:
    """Category of a failed fetch from its status or, without one, from the name of the error; null for a success."""
    text = F.lower(F.coalesce(error, F.lit("")))
    by_error = (
        F.when(text.rlike("robots|ignorerequest"), "robots_restricted")
        .when(text.rlike("playwright|browser"), "browser_failure")
        .when(text.rlike("dns"), "dns_failure")
        .when(text.rlike("timeout|timed out|refused"), "connection_timeout")
        .when(text != "", "unknown")
    )
    by_status = F.when(status == 403, "http_403").when(status == 429, "http_429").when(status.between(500, 599), "http_5xx")
    return F.when(status.between(200, 399), None).when(status.isNotNull(), F.coalesce(by_status, F.lit("http_other"))).otherwise(by_error)


def fold_attempts(attempts: DataFrame, hub: Column, article_s: int = 86_400, hub_s: int = 1_800) -> DataFrame:
    """The state of each URL after all its attempts: (url_id, attempts, last_outcome, failures, last_s, due_s).

    failures: attempts after the last success. due_s: a success is due again after ``hub_s`` for hubs and ``article_s`` otherwise; a
    failure after a minute, doubled with each failure up to six hours. ``attempts``: (id, url_id, outcome, attempted_at); an attempt
    logged twice counts once, rows without URL or time are left out. Two aggregates by URL; no window over a URL's history.
    """
    rows = attempts.where("url_id is not null and attempted_at is not null")
    rows = rows.select("id", "url_id", "outcome", F.unix_micros("attempted_at").alias("us"), hub.alias("hub")).dropDuplicates(["id"])
    good = F.col("outcome") == "success"
    success = rows.groupBy("url_id").agg(F.max(F.when(good, F.col("us"))).alias("_ok"))
    state = rows.join(success, "url_id").groupBy("url_id").agg(
        F.count("*").alias("attempts"),
        F.max_by("outcome", F.struct("us", "id")).alias("last_outcome"),
        F.count_if(~F.coalesce(good, F.lit(False)) & ((F.col("us") > F.col("_ok")) | F.col("_ok").isNull())).alias("failures"),
        F.max("us").alias("us"),
        F.max("hub").alias("hub"),
    )
    wait = F.least(F.lit(60) * F.pow(F.lit(2.0), F.least(F.col("failures") - 1, F.lit(20))), F.lit(21_600))
    wait = F.when(F.col("failures") == 0, F.when(F.col("hub"), hub_s).otherwise(article_s)).otherwise(wait).cast("long")
    last = F.floor(F.col("us") / 1_000_000)
    return state.select("url_id", "attempts", "last_outcome", "failures", last.alias("last_s"), (last + wait).alias("due_s"))


def set_state(urls: DataFrame, ids: DataFrame, status: str, reason: str | None = None) -> DataFrame:
    """``urls`` with those of ``ids`` (id, lease_owner) set to ``status``; a lease is given up only by its owner (null: anybody).

    reason, cut at 2,000 characters, goes to failure_category."""
    hit = ids.select("id", F.col("lease_owner").alias("_owner"), F.lit(True).alias("_hit"))
    own = F.coalesce(F.col("_hit") & (F.col("_owner").isNull() | F.col("_owner").eqNullSafe(F.col("lease_owner"))), F.lit(False))
    new = {"status": F.lit(status), "lease_owner": F.lit(None).cast("string")}
    if reason is not None:
        new["failure_category"] = F.lit(reason[:2000])
    joined = urls.join(hit, "id", "left").withColumn("_own", own)
    return joined.select(*[F.when(F.col("_own"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in urls.columns])
