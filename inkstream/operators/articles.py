"""From pages to stored articles: layered extraction, the crawl gate, the record cleaner, and the verdict on a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions import columns as C
from inkstream.functions.pages import Selectors, ld_fields, linked_data, opengraph, plain_text, selected_udf
from inkstream.functions.vectorised import nfc_udf, normalize_text_udf
from inkstream.operators.duplicates import nearest_fingerprint

FIELDS = "title subtitle author category published_at updated_at body summary image_urls tags canonical_url".split()


def extract_articles(pages: DataFrame, key: str, page: str, selectors: Selectors = Selectors()) -> DataFrame:
    """(key, fields, extraction_method, extraction_confidence) of each page.

    A field comes from the first layer that has it: the first article object of the JSON-LD, then OpenGraph, then the selectors.
    Confidence: 0.95 with a body from JSON-LD; 0.85 with JSON-LD and a body by selectors; 0.75 with a body by selectors alone; else
    0.3 with a title and 0 without. A null page has no fields and confidence 0.
    """
    raw = pages.select(F.col(key), F.col(page).alias("_page"))
    found = raw.withColumn("_ld", F.get(linked_data(F.col("_page")), F.lit(0)))
    found = found.select(key, "_page", ld_fields(F.col("_ld")).alias("ld"), F.col("_ld").isNotNull().alias("has_ld"))
    found = found.withColumn("og", opengraph(F.col("_page"))).withColumn("sel", selected_udf(selectors)("_page"))
    found = found.withColumn("ld_body", F.when(F.col("ld.body").isNotNull(), F.nullif(plain_text(F.col("ld.body")), F.lit("")))).drop("_page")

    def first(name: str) -> Column:
        layers = {"ld": "title subtitle author category published_at updated_at summary canonical_url", "og": "title summary published_at updated_at category canonical_url", "sel": "title subtitle author published_at category"}
        return F.coalesce(*[F.col(f"{x}.{name}") for x, has in layers.items() if name in has.split()]).alias(name)

    def first_list(*lists: Column) -> Column:
        out = lists[-1]
        for x in reversed(lists[:-1]):
            out = F.when(F.size(x) > 0, x).otherwise(out)
        return F.coalesce(out, F.array().cast("array<string>"))

    body = F.coalesce("ld_body", "sel.body")
    image = F.when(F.col("og.image").isNotNull(), F.array("og.image")).otherwise(F.array().cast("array<string>"))
    plain = [first(x) for x in FIELDS if x not in ("body", "image_urls", "tags")]
    lists = [first_list(F.col("ld.tags"), F.col("sel.tags")).alias("tags"), first_list(F.col("ld.image_urls"), image, F.col("sel.image_urls")).alias("image_urls")]
    out = found.select(key, *plain, body.alias("body"), *lists, "has_ld", F.col("ld_body").isNotNull().alias("own_body"))
    by_hand = F.col("body").isNotNull()
    method = F.when(F.col("own_body"), "json_ld").when(by_hand, "selectors").otherwise("opengraph")
    sure = F.when(F.col("own_body"), 0.95).when(by_hand & F.col("has_ld"), 0.85).when(by_hand, 0.75).when(F.col("title").isNotNull(), 0.3)
    return out.select(key, *FIELDS, method.alias("extraction_method"), F.coalesce(sure, F.lit(0.0)).alias("extraction_confidence"))


def crawl_gate(rows: DataFrame, changed: Column, location: str) -> DataFrame:
    """``rows`` (title, body and others) with ``gate``: no_content, unchanged, no_location, or pass, whichever holds first."""
    empty = F.coalesce(F.col("title"), F.lit("")) == ""
    empty |= F.coalesce(F.col("body"), F.lit("")) == ""
    missing = F.coalesce(F.col(location), F.lit("")) == ""
    gate = F.when(empty, "no_content").when(~F.coalesce(changed, F.lit(False)), "unchanged").when(missing, "no_location")
    return rows.withColumn("gate", gate.otherwise("pass"))


def _tidy(name: str) -> Column:
    return F.nullif(normalize_text_udf(F.coalesce(F.col(name), F.lit(""))), F.lit(""))


def clean_extracted(rows: DataFrame, key: str, least_title: int = 5, least_body: int = 100) -> tuple[DataFrame, DataFrame]:
    """(cleaned, rejected) of extracted records (key and text columns; any other columns are left out).

    cleaned: texts in NFC with single spaces, empty ones null; body lines parted by blank lines; at most 20 image addresses and 50
    tags; language from the script of title and the body's first 2,000 characters; word count; SHA-256 of the content.
    rejected: (key, reason) of records whose title has under ``least_title`` characters or whose body under ``least_body``.
    """
    texts = rows.select(
        key, *[_tidy(x).alias(x) for x in ("title", "subtitle", "author", "category", "summary")],
        C.clean_body(nfc_udf("body")).alias("body"), "published_at", "updated_at", "image_urls", "tags",
        "extraction_method", "extraction_confidence",
    )
    short_title = F.length(F.coalesce("title", F.lit(""))) < least_title
    short_body = F.length("body") < least_body
    reason = F.when(short_title, "title too short").when(short_body, "body too short")
    judged = texts.withColumn("reason", reason)

    def some(name: str, most: int) -> Column:
        kept = F.filter(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
        return F.slice(kept, 1, most)

    tags = F.transform(some("tags", 50), lambda t: C.collapse(t))
    head = F.concat_ws(" ", "title", F.substring("body", 1, 2000))
    digest = C.content_hash(F.col("title"), F.col("author"), F.col("published_at"), F.col("body"))
    cleaned = judged.where("reason is null").select(
        key, "title", "subtitle", "author", "category", "summary", "published_at", "updated_at", "body",
        some("image_urls", 20).alias("image_urls"), tags.alias("tags"), C.script_language(head).alias("language"),
        C.word_count(F.col("body")).alias("word_count"), digest.alias("content_hash"),
        F.coalesce("extraction_method", F.lit("selectors")).alias("extraction_method"),
        F.coalesce("extraction_confidence", F.lit(0.0)).alias("extraction_confidence"),
    )
    return cleaned, judged.where("reason is not null").select(key, "reason")


def persist_verdicts(incoming: DataFrame, history: DataFrame) -> DataFrame:
    """(article_id, verdict, other) of each incoming record against the accepted ones.

    A known canonical address gives unchanged or updated, by the content hash. Else an equal content hash gives duplicate (stage
    exact), and a fingerprint within 3 bits gives duplicate (stage near); else created. other is the accepted article: of several, the
    smallest id for addresses and hashes, and the nearest, then smallest, for fingerprints. Nulls match nothing.
    """
    new = incoming.select("article_id", "canonical_url", "content_hash", "simhash")

    def known(column: str, *more: str) -> DataFrame:
        own = history.where(F.col(column).isNotNull()).groupBy(column)
        return own.agg(F.min("article_id").alias(f"by_{column}"), *[F.min_by(x, "article_id").alias(f"known_{x}") for x in more])

    judged = new.join(known("canonical_url", "content_hash"), "canonical_url", "left").join(known("content_hash"), "content_hash", "left")
    open_ = judged.where("by_canonical_url is null and by_content_hash is null and simhash is not null and simhash <> 0")
    near = nearest_fingerprint(open_.select("article_id", "simhash"), history, "article_id", "simhash", 3)
    judged = judged.join(near.select("article_id", F.col("other").alias("by_simhash")), "article_id", "left")
    verdict = (
        F.when(F.col("by_canonical_url").isNotNull(), F.when(F.col("known_content_hash").eqNullSafe(F.col("content_hash")), "unchanged").otherwise("updated"))
        .when(F.col("by_content_hash").isNotNull(), "duplicate_exact")
        .when(F.col("by_simhash").isNotNull(), "duplicate_near")
        .otherwise("created")
    )
    other = F.coalesce("by_canonical_url", "by_content_hash", "by_simhash").alias("other")
    return judged.select("article_id", verdict.alias("verdict"), other)
