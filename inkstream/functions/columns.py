"""Native Column builders: text, hashes, languages, URLs and scores that stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str.split sees it; Java's \s alone misses the no-break space and U+001C to U+001F.
WHITESPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]+"
SEPARATOR = "\u001e"


def collapse(text: Column) -> Column:
    """Runs of white space as one space, trimmed, without zero-width space and byte-order mark; null gives ''."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "[​﻿]", "")
    return F.trim(F.regexp_replace(bare, WHITESPACE, " "))


def clean_body(body: Column) -> Column:
    """Lines collapsed, empty ones dropped, joined by a blank line."""
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), collapse)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n\n")


def word_count(text: Column) -> Column:
    """Number of white-space separated words; 0 for null and blank."""
    flat = collapse(text)
    return F.when(flat == "", F.lit(0)).otherwise(F.size(F.split(flat, " "))).cast("int")


def content_hash(*fields: Column, extra: dict[str, Column] | None = None) -> Column:
    """SHA-256 of the collapsed fields joined by U+001E, then of ``extra`` as name=value in name order; null counts as ''."""
    more = [F.concat(F.lit(f"{name}="), collapse(extra[name])) for name in sorted(extra or {})]
    return F.sha2(F.concat_ws(SEPARATOR, *[collapse(f) for f in fields], *more), 256)


def script_language(text: Column, least: int = 10, share: float = 0.25) -> Column:
    """'bn', 'en' or 'unknown' from the counts of Bengali and basic Latin letters."""
    body = F.coalesce(text, F.lit(""))
    bengali = F.regexp_count(body, F.lit("[ঀ-৿]"))
    latin = F.regexp_count(body, F.lit("[A-Za-z]"))
    return F.when(bengali + latin < least, "unknown").when(bengali >= latin * share, "bn").otherwise("en")


def query_language(q: Column) -> Column:
    """Language of a short query, null when neither script has two letters or more."""
    bengali = F.regexp_count(q, F.lit("[ঀ-৿]"))
    latin = F.regexp_count(q, F.lit("[A-Za-z]"))
    return F.when((bengali >= 2) & (bengali >= latin), "bn").when((latin >= 2) & (latin > bengali), "en")


def bands(fingerprint: Column, count: int = 4, width: int = 16) -> Column:
    """The fingerprint's blocks, lowest first; arithmetic shift and mask work for negative values too."""
    shifts = F.array(*[F.lit(i * width) for i in range(count)])
    return F.transform(shifts, lambda s: F.call_function("shiftright", fingerprint, s).bitwiseAND(F.lit((1 << width) - 1)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two float arrays in double precision; 0 when a norm is 0."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def slug(text: Column) -> Column:
    """Lower case, punctuation and symbols (but '-') dropped, white space as '-', at most 200 characters."""
    low = F.regexp_replace(F.lower(F.trim(text)), r"[\p{P}\p{S}&&[^-]]", "")
    dashed = F.regexp_replace(low, r"[\s_]+", "-")
    return F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, 200)


def bucket_and_key(uri: Column) -> Column:
    """(bucket, key) of an s3:// address; null fields for anything else."""
    text = F.trim(uri)
    pattern = r"^s3://([^/]+)/(.+)$"
    hit = text.rlike(pattern)
    return F.struct(
        F.when(hit, F.regexp_extract(text, pattern, 1)).alias("bucket"), F.when(hit, F.regexp_extract(text, pattern, 2)).alias("key")
    )


def raw_key(source: Column, at: Column, url_id: Column) -> Column:
    """Storage key of a raw page."""
    return F.concat(
        F.lit("raw/"), source, F.lit("/"), F.date_format(at, "yyyy/MM/dd"), F.lit("/"), url_id.cast("string"), F.lit("-"),
        F.date_format(at, "HHmmss"), F.lit(".html"),
    )


def url_domain(url: Column) -> Column:
    """Host without port, lower case; null without a host."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def domain_allowed(domain: Column, allowed: Column) -> Column:
    """Whether a domain equals an allowed one or lies under it; an empty or null list allows all."""
    inside = F.exists(allowed, lambda d: (domain == d) | F.endswith(domain, F.concat(F.lit("."), d)))
    return F.when(F.coalesce(F.size(allowed), F.lit(0)) <= 0, F.lit(True)).otherwise(F.coalesce(inside, F.lit(False)))


def like_pattern(q: str) -> str:
    """'%q%' with q's own wildcards in force; a backslash is made literal, as a stray one is an error in Spark."""
    return "%" + q.replace("\\", "\\\\") + "%"


def backoff_seconds(retries: Column, base: int = 60, most: int = 21_600, blocked: Column | None = None) -> Column:
    """base * 2 ** (retries - 1), at most ``most``; four times that where ``blocked``. Without jitter."""
    n = F.greatest(retries, F.lit(1))
    wait = F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.least(n - 1, F.lit(40))), F.lit(float(most)))
    return wait if blocked is None else F.when(blocked, wait * 4).otherwise(wait)


def epoch_s(at: Column) -> Column:
    return F.floor(F.unix_micros(at) / 1_000_000)


def day(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def heuristic_summary(title: Column, body: Column) -> Column:
    """The body's start in place of a summary: at most 400 characters cut at the last space, else the title, else a set sentence."""
    head = F.trim(F.coalesce(title, F.lit("")))
    text = F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), r"(?U)\s+", " "))
    text = F.when(F.length(text) < 40, head).otherwise(text)
    start = F.substring(text, 1, 400)
    text = F.when(F.length(text) > 400, F.regexp_replace(start, r"(?s) [^ ]*$", "")).otherwise(text)
    none = F.lit("Article summary unavailable.")
    text = F.when(F.length(text) >= 10, text).otherwise(F.substring(F.when(head != "", head).otherwise(none), 1, 200))
    return F.when(F.length(text) < 10, none).otherwise(text)
