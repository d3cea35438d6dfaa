"""Lines repeated across the documents of one source: found by document share, then taken out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.session import materialize

# White space as Unicode has it, without the line break itself.
SPACES = r"[\t\x0b-\r\x1c-\x20\x85   -     　]+"


def line_key(line: Column) -> Column:
    """Lower case, white space as single spaces, trimmed, each run of digits (of any script) as one sign."""
    text = F.trim(F.regexp_replace(F.lower(line), SPACES, " "))
    return F.regexp_replace(text, r"\p{Nd}+", "#")


def line_hashes(bodies: DataFrame) -> DataFrame:
    """(doc, line_no, key) of each non-empty line; ``bodies``: (doc, body).

    Lines are split at the line feed and counted from 1, empty ones counted. A line of white space only is empty. Null bodies
    give none. Hashing comes before any join, so that no body is shuffled.
    """
    lines = bodies.select("doc", F.posexplode(F.split("body", "\n")).alias("p", "line"))
    keyed = lines.select("doc", (F.col("p") + 1).alias("line_no"), line_key(F.col("line")).alias("text"))
    return keyed.where("text <> ''").select("doc", "line_no", F.xxhash64("text").alias("key"))


def source_lines(bodies: DataFrame, origins: DataFrame) -> DataFrame:
    """(doc, source, line_no, key) as a written table; ``origins``: (doc, source), one row a document.

    Documents without source are left out.
    """
    origins = origins.select("doc", "source").where("source is not null")
    return materialize(line_hashes(bodies).join(origins, "doc").select("doc", "source", "line_no", "key"), "lines")


def frequent_lines(lines: DataFrame, bodies: DataFrame, origins: DataFrame, least_docs: int, least_share: float) -> DataFrame:
    """(source, key, docs) of lines in at least ``least_docs`` documents and ``least_share`` of the source's documents.

    ``lines`` as from ``source_lines``. A line counts once a document, and a document counts once. Counting runs in two steps, so
    that a source with a third of all rows is spread over its (document, line) pairs before anything is gathered by source.
    """
    counts = lines.select("source", "key", "doc").distinct().groupBy("source", "key").agg(F.count("*").alias("docs"))
    counts = counts.where(F.col("docs") >= least_docs)
    with_body = bodies.where("body is not null").select("doc").distinct().join(origins.select("doc", "source").where("source is not null"), "doc")
    totals = with_body.groupBy("source").agg(F.count("*").alias("total"))
    return counts.join(totals, "source").where(F.col("docs") >= F.col("total") * least_share - 1e-9).select("source", "key", "docs")


def repeated_lines(bodies: DataFrame, origins: DataFrame, least_docs: int = 3, least_share: float = 0.02) -> DataFrame:
    """(doc, source, line_no) of every line that is frequent in its source."""
    lines = source_lines(bodies, origins)
    frequent = frequent_lines(lines, bodies, origins, least_docs, least_share).select("source", "key")
    return lines.join(frequent, ["source", "key"], "left_semi").select("doc", "source", "line_no").distinct()


def without_repeated_lines(bodies: DataFrame, origins: DataFrame, least_docs: int = 3, least_share: float = 0.02) -> DataFrame:
    """``bodies`` with a column ``clean_body``: the body without its frequent lines, other lines as they were.

    A body all of whose lines go becomes ''; a null body stays null. Columns named clean_body are replaced.
    """
    drop = repeated_lines(bodies, origins, least_docs, least_share).groupBy("doc").agg(F.collect_set("line_no").alias("_drop"))
    kept = F.filter(
        F.transform(F.split("body", "\n"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("line"))),
        lambda s: F.col("_drop").isNull() | ~F.array_contains(F.coalesce("_drop", F.array().cast("array<int>")), s["n"]),
    )
    joined = bodies.drop("clean_body", "_drop").join(drop, "doc", "left")
    return joined.withColumn("clean_body", F.array_join(F.transform(kept, lambda s: s["line"]), "\n")).drop("_drop")
