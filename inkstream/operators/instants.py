"""Mixed timestamp formats and zones to UTC instants, through a dictionary of distinct values.

Raw strings repeat (feeds, placeholders, whole pages fetched again), and parsing them needs Python, so each
distinct (string, zone, date order) is parsed once. The dictionary is a table that can be kept and extended:
``extend_dictionary`` parses only values it does not hold yet.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstream.functions.timestamps import parse_epoch

KEY = ["raw", "tz_name", "date_order"]


@F.pandas_udf(T.LongType())
def parse_epoch_udf(raw: pd.Series, tz_name: pd.Series, date_order: pd.Series) -> pd.Series:
    return pd.Series([parse_epoch(*x) for x in zip(raw, tz_name, date_order)], dtype="Int64")


def distinct_values(values: DataFrame) -> DataFrame:
    """The distinct (raw, tz_name, date_order) of ``values``; null strings are left out, blanks trimmed away."""
    raw = F.regexp_replace(F.col("raw"), r"^\s+|\s+$", "")
    return values.select(raw.alias("raw"), "tz_name", "date_order").where("raw is not null and raw <> ''").distinct()


def extend_dictionary(values: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Dictionary rows (raw, tz_name, date_order, epoch_s) for the values of ``values`` that ``known`` lacks.

    The caller appends the result to the stored dictionary. epoch_s is null for strings that are no instant,
    so that they aren't parsed again either.
    """
    fresh = distinct_values(values)
    if known is not None:
        on = [fresh[k].eqNullSafe(known[k]) for k in KEY]
        fresh = fresh.join(known, on, "left_anti")
    return fresh.withColumn("epoch_s", parse_epoch_udf(*KEY))


def normalise_instants(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``rows`` (with raw, tz_name, date_order) plus epoch_s; rows without an instant get null.

    Null zones or orders compare equal to null. Clashing columns: a column ``epoch_s`` of ``rows`` is replaced.
    """
    rows = rows.drop("epoch_s").withColumn("_raw", F.regexp_replace(F.col("raw"), r"^\s+|\s+$", ""))
    d = dictionary.select(F.col("raw").alias("_d_raw"), F.col("tz_name").alias("_d_tz"), F.col("date_order").alias("_d_order"), "epoch_s")
    on = (F.col("_raw") == F.col("_d_raw")) & F.col("tz_name").eqNullSafe(F.col("_d_tz")) & F.col("date_order").eqNullSafe(F.col("_d_order"))
    return rows.join(d, on, "left").drop("_raw", "_d_raw", "_d_tz", "_d_order")


def page_times(extracted: DataFrame, pages: DataFrame, sources: DataFrame, locales: DataFrame) -> DataFrame:
    """One row per record and time field: (page_id, field_name, raw, tz_name, date_order).

    The zone comes from the page's source (by slug) and its country. A page delivered twice counts once; a record
    whose page or source is unknown keeps null zone and order, so only its zoned values can be read.
    """
    zones = sources.select(F.col("slug").alias("source_slug"), "country").dropDuplicates(["source_slug"]).join(
        locales.select("country", "tz_name", "date_order").dropDuplicates(["country"]), "country", "left"
    )
    origin = pages.where("source_slug is not null").groupBy("page_id").agg(F.min("source_slug").alias("source_slug"))
    origin = origin.join(zones.select("source_slug", "tz_name", "date_order"), "source_slug", "left")
    fields = extracted.select(
        "page_id",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw")) for f in ("published_at", "updated_at")])).alias("x"),
    ).select("page_id", "x.field_name", "x.raw")
    fields = fields.where("raw is not null")
    return fields.join(origin, "page_id", "left").select("page_id", "field_name", "raw", "tz_name", "date_order")
