"""Upserts, deletes and merges as joins that rewrite the state; the caller swaps versions of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ascending ``order``, nulls first; the columns stay as they are. Aggregated before the shuffle, no sort."""
    best = rows.groupBy(*[F.col(k).alias(f"_key_{k}") for k in key]).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def insert_if_absent(state: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``state`` with the rows whose key it lacks."""
    return state.unionByName(rows.join(state.select(*key), key, "left_anti"))


def replace_by_key(state: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``state`` with every row of a key in ``rows`` replaced by those (delete, then insert)."""
    return state.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows)


def update_matched(state: DataFrame, rows: DataFrame, key: list[str], changes: dict[str, Column], when: Column | None = None) -> DataFrame:
    """Upsert: a known key has the columns in ``changes`` set (where ``when`` holds), an unknown one is inserted.

    ``changes`` and ``when`` may use the state's columns and, as ``new_<column>``, those of ``rows`` (one row a key).
    """
    new = rows.select(*[F.col(c).alias(f"new_{c}") for c in rows.columns])
    on = [F.col(k) == F.col(f"new_{k}") for k in key]
    joined = state.join(new, on, "left")
    matched = F.col(f"new_{key[0]}").isNotNull() & (F.lit(True) if when is None else when)
    kept = joined.select(*[(F.when(matched, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)) for c in state.columns])
    return kept.unionByName(rows.join(state.select(*key), key, "left_anti").select(*state.columns))


def add_counters(state: DataFrame, deltas: DataFrame, key: list[str], value: str) -> DataFrame:
    """Additive upsert: (key, value) summed over both sides; deltas of 0 or less are ignored."""
    both = state.select(*key, value).unionByName(deltas.where(F.col(value) > 0).select(*key, value))
    return both.groupBy(*key).agg(F.sum(value).alias(value))


def add_named_counters(state: DataFrame, deltas: DataFrame, key: list[str], name: str, value: str, known: list[str]) -> DataFrame:
    """Additive upsert by key and counter name. A name outside ``known`` fails the query, whatever its delta; deltas of 0 are ignored."""
    unknown = F.raise_error(F.concat(F.lit("unknown counter: "), F.coalesce(name, F.lit("null"))))
    checked = deltas.withColumn(value, F.when(F.coalesce(F.col(name).isin(*known), F.lit(False)), F.col(value)).otherwise(unknown.cast("bigint")))
    both = state.select(*key, name, value).unionByName(checked.where(F.col(value) != 0).select(*key, name, value))
    return both.groupBy(*key, name).agg(F.sum(value).alias(value))


def greatest_merge(state: DataFrame, floor: DataFrame, key: list[str], value: str) -> DataFrame:
    """Upsert that never lowers a value: the larger of both sides by key."""
    both = state.select(*key, value).unionByName(floor.select(*key, value))
    return both.groupBy(*key).agg(F.max(value).alias(value))


def merge_counts(a: Column, b: Column) -> Column:
    """Sum of two maps of counts by key."""
    zero = F.lit(0).cast("bigint")
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


def delete_cascade(parent: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str, victims: DataFrame) -> dict[str, DataFrame]:
    """The survivors of ``parent`` (under 'parent') and of each child table by its foreign key, without ``victims``' keys."""
    gone = victims.select(key).distinct()
    out = {"parent": parent.join(gone, key, "left_anti")}
    for name, (child, column) in children.items():
        out[name] = child.join(gone.withColumnRenamed(key, column), column, "left_anti")
    return out


def null_references(rows: DataFrame, column: str, victims: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``column`` set to null where it points at a victim."""
    gone = victims.select(F.col(key).alias("_gone")).distinct()
    hit = F.col("_gone").isNotNull()
    return rows.join(gone, F.col(column) == F.col("_gone"), "left").withColumn(column, F.when(~hit, F.col(column))).drop("_gone")


def with_versions(rows: DataFrame, key: str, order: list, watched: list[str]) -> DataFrame:
    """Version number of each row of its key, and for each watched column whether it differs from the version before.

    The first version has no changes; null equals null.
    """
    w = W.partitionBy(key).orderBy(*order)
    out = rows.withColumn("version", F.row_number().over(w))
    for c in watched:
        changed = (F.col("version") > 1) & ~F.col(c).eqNullSafe(F.col(f"_{c}"))
        out = out.withColumn(f"_{c}", F.lag(c).over(w)).withColumn(f"{c}_changed", changed).drop(f"_{c}")
    return out
