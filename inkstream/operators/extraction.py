"""Feeds, sitemaps and model replies, taken apart with native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _tag(item: Column, name: str) -> Column:
    inside = F.trim(F.regexp_extract(item, f"(?s)<{name}(?:\\s[^>]*)?>(.*?)</{name}>", 1))
    return F.nullif(F.trim(F.regexp_replace(inside, r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1")), F.lit(""))


def sitemap_entries(xml: Column) -> Column:
    """Array of (loc, lastmod) of a urlset's entries."""
    items = F.regexp_extract_all(xml, F.lit("(?s)<url>(.*?)</url>"), F.lit(1))
    return F.filter(F.transform(items, lambda x: F.struct(_tag(x, "loc").alias("loc"), _tag(x, "lastmod").alias("lastmod"))), lambda s: s["loc"].isNotNull())


def sitemap_children(xml: Column, newest: int = 3) -> Column:
    """The newest child sitemaps of a sitemap index, by lastmod (missing ones last), then by address, both descending."""
    items = F.regexp_extract_all(xml, F.lit("(?s)<sitemap>(.*?)</sitemap>"), F.lit(1))
    pairs = F.transform(items, lambda x: F.struct(F.coalesce(_tag(x, "lastmod"), F.lit("")).alias("lastmod"), _tag(x, "loc").alias("loc")))
    return F.transform(F.slice(F.reverse(F.array_sort(F.filter(pairs, lambda s: s["loc"].isNotNull()))), 1, newest), lambda s: s["loc"])


def feed_entries(xml: Column) -> Column:
    """Array of (title, link, published) of an RSS or Atom feed; published falls back to updated. Entities stay, CDATA is opened."""
    items = F.regexp_extract_all(xml, F.lit("(?s)<(?:item|entry)\\b[^>]*>(.*?)</(?:item|entry)>"), F.lit(1))

    def entry(x: Column) -> Column:
        href = F.nullif(F.regexp_extract(x, "<link[^>]*href=[\"']([^\"']+)", 1), F.lit(""))
        at = F.coalesce(_tag(x, "pubDate"), _tag(x, "published"), _tag(x, "updated"))
        return F.struct(_tag(x, "title").alias("title"), F.coalesce(_tag(x, "link"), href).alias("link"), at.alias("published"))

    return F.transform(items, entry)


def recover_json(reply: Column, schema: str) -> Column:
    """The outermost object of a reply (fenced, padded with prose or bare) parsed by ``schema``; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit("")), schema, {"mode": "PERMISSIVE"})


def tokens(text: Column, longer_than: int = 2) -> Column:
    """Distinct lower-case words of more than ``longer_than`` characters, Bengali marks included."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_ঀ-৿]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > longer_than))


# Words, and in Bengali stems, that tell the mood of a text.
POSITIVE_WORDS = "win wins victory growth surge record hope peace aid rescue success improve improved celebrate breakthrough".split()
NEGATIVE_WORDS = (
    "kill killed death dead attack attacked crash flood flooding disaster crisis war protest arrest arrested violence bomb fail failed "
    "collapse corruption"
).split()
POSITIVE_STEMS_BN = "জয় উন্নতি সাফল্য শান্তি উদ্ধার আশা উৎসব বৃদ্ধি".split()
NEGATIVE_STEMS_BN = "মৃত্যু নিহত হামলা বন্যা দুর্যোগ সংকট যুদ্ধ বন্দি দুর্নীতি ধ্বংস হামলার".split()


def mood(title: Column, body: Column) -> Column:
    """'positive', 'negative' or 'neutral', by a margin of two mood words in the title and the first 800 characters.

    Bengali stems count once where the text holds them; positive ones once more for each word that holds one.
    """
    text = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(F.coalesce(body, F.lit("")), 1, 800))
    words = tokens(text)

    def among(known: list[str]) -> Column:
        return F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in known])))

    def held(stems: list[str]) -> Column:
        return sum((F.contains(text, F.lit(s)).cast("int") for s in stems), F.lit(0))

    inside = F.size(F.filter(words, lambda t: F.exists(F.array(*[F.lit(s) for s in POSITIVE_STEMS_BN]), lambda s: F.contains(t, s))))
    up = among(POSITIVE_WORDS) + inside + held(POSITIVE_STEMS_BN)
    down = among(NEGATIVE_WORDS) + held(NEGATIVE_STEMS_BN)
    return F.when(up > down + 1, "positive").when(down > up + 1, "negative").otherwise("neutral")


def link_dimension(rows: DataFrame, dim: DataFrame, key: list[str], dim_id: str) -> tuple[DataFrame, DataFrame]:
    """(new dimension rows, bridge) of ``rows`` (key columns and others): keys that ``dim`` lacks get ids after its largest.

    New keys are numbered in key order; the bridge is ``rows`` with the id of their key, each link once. Rows with a null key
    are left out.
    """
    given = rows.dropna(subset=key)
    fresh = given.select(*key).distinct().join(dim.select(*key), key, "left_anti")
    top = dim.agg(F.coalesce(F.max(dim_id), F.lit(0))).first()[0]
    made = numbered(fresh, key).select((F.col("_n") + F.lit(top)).alias(dim_id), *key)
    bridge = given.join(dim.select(dim_id, *key).unionByName(made), key).distinct()
    return made, bridge


def deferred_places(rows: DataFrame, late: Column, at: str, key: str) -> DataFrame:
    """(key, place): every row's place in the queue by time and key, rows that are ``late`` after all others; no time goes last."""
    order = rows.select(late.cast("int").alias("_late"), F.col(at).isNull().alias("_none"), at, key)
    return numbered(order, order.columns).select(key, F.col("_n").cast("int").alias("place"))


def numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` numbered from 1 in key order, without gathering them: ranges are numbered apart and offset by their sizes."""
    from pyspark.sql import Window as W

    ranged = rows.repartitionByRange(*key).withColumn("_p", F.spark_partition_id())
    inside = ranged.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(*key)))
    sizes = inside.groupBy("_p").agg(F.max("_i").alias("_size"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    offsets = sizes.select("_p", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_o"))
    return inside.join(F.broadcast(offsets), "_p").select((F.col("_i") + F.col("_o")).alias("_n"), *key)  # a row a range
