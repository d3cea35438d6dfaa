"""Replies of a language model: checks and normal forms; and the analysis that stands in where there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions.columns import heuristic_summary
from inkstream.operators.extraction import mood, tokens

# The labels a reply may use.
SENTIMENTS = ("positive", "negative", "neutral", "mixed")
ENTITY_TYPES = ("person", "organization", "location", "event", "other")


def heuristic_analysis(title: Column, body: Column) -> Column:
    """(summary, sentiment, keywords): the body's start, the mood, and the first 12 words in alphabetical order that are of letters."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(F.coalesce(body, F.lit("")), 1, 800))
    letters = F.filter(tokens(text), lambda t: t.rlike(r"^[\p{L}\p{M}]+$"))
    return F.struct(heuristic_summary(title, body).alias("summary"), mood(title, body).alias("sentiment"), F.slice(F.array_sort(letters), 1, 12).alias("keywords"))


def _texts(v: Column, most: int) -> Column:
    """The non-blank members of a list as trimmed text, at most ``most``; anything but a list counts as empty."""
    items = F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array().cast("array<string>"))
    return F.slice(F.filter(F.transform(items, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""), 1, most)


def _entities(v: Column) -> Column:
    """(name, type) of a list of objects (the name may be called entity), or of an object of name: type pairs, in name order.

    A value that is no known type is taken for the name itself, with type other."""
    listed = F.transform(
        F.try_variant_get(v, "$", "array<struct<name:string,entity:string,type:string>>"),
        lambda e: F.struct(F.trim(F.coalesce(e["name"], e["entity"])).alias("name"), F.lower(F.trim(e["type"])).alias("type")),
    )
    pairs = F.array_sort(F.map_entries(F.try_variant_get(v, "$", "map<string,string>")))

    def pair(e: Column) -> Column:
        kind = F.lower(F.trim(e["value"]))
        known = F.coalesce(kind.isin(*ENTITY_TYPES), F.lit(False))
        name = F.when(known, e["key"]).otherwise(F.coalesce(F.nullif(F.trim(e["value"]), F.lit("")), e["key"]))
        return F.struct(name.alias("name"), F.when(known, kind).otherwise("other").alias("type"))

    return F.coalesce(listed, F.transform(pairs, pair), F.array().cast("array<struct<name:string,type:string>>"))


def validate_analyses(rows: DataFrame, reply: str) -> DataFrame:
    """``rows`` with ``analysis`` (summary, topics, entities, sentiment, keywords) and ``reason``, of which one is null.

    The outermost object of the reply counts. Summaries have 10 to 2,000 characters; at most 10 topics and 15 keywords are kept;
    more than 50 entities, an entity without a name or of an unknown type, and an unknown sentiment are refused; a missing sentiment is neutral.
    """
    text = F.nullif(F.regexp_extract(F.coalesce(F.col(reply), F.lit("")), r"(?s)(\{.*\})", 1), F.lit(""))
    v = rows.withColumn("_v", F.try_parse_json(text))
    part = lambda name: F.try_variant_get("_v", f"$.{name}", "variant")
    mood_ = F.lower(F.trim(F.coalesce(F.try_variant_get("_v", "$.sentiment", "string"), F.lit(""))))
    v = v.withColumns(
        {
            "_summary": F.try_variant_get("_v", "$.summary", "string"), "_topics": _texts(part("topics"), 10), "_entities": _entities(part("entities")),
            "_sentiment": F.when(mood_ == "", "neutral").otherwise(mood_), "_keywords": _texts(part("keywords"), 15),
        }
    )
    bad = lambda e: (F.coalesce(e["name"], F.lit("")) == "") | (F.length(e["name"]) > 500) | ~F.coalesce(e["type"].isin(*ENTITY_TYPES), F.lit(False))
    size = F.length(F.coalesce("_summary", F.lit("")))
    reason = (
        F.when(F.col("_v").isNull(), "no object")
        .when((size < 10) | (size > 2000), "summary")
        .when(~F.col("_sentiment").isin(*SENTIMENTS), "sentiment")
        .when((F.size("_entities") > 50) | F.exists("_entities", bad), "entities")
    )
    fields = F.struct(*[F.col(f"_{x}").alias(x) for x in ("summary", "topics", "entities", "sentiment", "keywords")])
    return v.withColumn("reason", reason).withColumn("analysis", F.when(F.col("reason").isNull(), fields)).select(*rows.columns, "analysis", "reason")


def to_enrich(articles: DataFrame) -> DataFrame:
    """Articles that lack a sentiment or a summary."""
    return articles.where("sentiment is null or summary is null or summary = ''")


def prompt(title: Column, body: Column, most: int = 1200) -> Column:
    """The text a model is asked about: title, and the body's start."""
    return F.format_string("Title: %s\n\nBody: %s", F.coalesce(title, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, most))
