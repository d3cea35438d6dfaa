"""Exact copies, stored SimHash neighbours and vector neighbours."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstream.functions.columns import cosine, hamming


def exact_copies(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, original): each row whose value a row of smaller key has; original is the smallest. Nulls are no copies."""
    first = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(key).alias("original"), F.count("*").alias("_n")).where("_n > 1")
    return rows.select(key, value).join(first, value).where(F.col(key) > F.col("original")).select(key, "original")


def _block_masks(sizes: list[int], low: int = 0) -> list[int]:
    """Masks of neighbouring blocks of bits, from bit ``low`` on."""
    out = []
    for size in sizes:
        out.append(((1 << size) - 1) << low)
        low += size
    return out


# 3 differing bits leave 2 of 5 blocks alone: ten tables of 25 or 26 bits.
NEAR_TABLES = [a | b for a, b in combinations(_block_masks([13, 13, 13, 13, 12]), 2)]


def _gray_tables() -> list[int]:
    """A block of 16 bits with each seventh of the other 48: what agrees in the block and differs in at most 6 bits elsewhere
    agrees in one of the sevenths too."""
    out = []
    for band in range(4):
        own, others = 0xFFFF << (16 * band), [i for i in range(64) if i // 16 != band]
        for k in range(7):
            out.append(own | sum(1 << i for i in others[k * 7 : k * 7 + 7]))
    return out


GRAY_TABLES = _gray_tables()


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keys(fingerprint: Column, tables: list[int]) -> Column:
    masks = F.array(*[F.lit(_signed(m)) for m in tables])
    return F.transform(masks, lambda m: fingerprint.bitwiseAND(m))


def banded_pairs(rows: DataFrame, key: str, fingerprint: str, most: int) -> DataFrame:
    """(a, b, distance) of fingerprints within ``most`` differing bits, at most 3.

    Two 64-bit values that differ in at most 3 bits agree in two of five blocks, so they meet in one of ten tables, by keys long
    enough to keep chance meetings rare. Equal fingerprints are paired through their smallest key only (they are copies);
    fingerprint 0 belongs to empty texts and is left out.
    """
    if not 0 <= most <= 3:
        raise ValueError("the tables guarantee distances of at most 3")
    one, same = _distinct(rows, key, fingerprint)
    return _meet(one, NEAR_TABLES, 0, most).unionByName(same)


def gray_pairs(rows: DataFrame, key: str, fingerprint: str, least: int = 4, most: int = 6) -> DataFrame:
    """Pairs at ``least`` to ``most`` (at most 6) differing bits that agree in one of four blocks of 16; they need another check."""
    if not 0 < least <= most <= 6:
        raise ValueError("the tables guarantee distances of at most 6")
    return _meet(_distinct(rows, key, fingerprint)[0], GRAY_TABLES, least, most)


def nearest_of(pairs: DataFrame, most: int = 10) -> DataFrame:
    """(id, other, distance, rank): of each id on either side of ``pairs`` (a, b, distance) the ``most`` nearest, then smallest."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "distance")
    both = both.unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "distance"))
    rank = F.row_number().over(W.partitionBy("id").orderBy("distance", "other"))
    return both.withColumn("rank", rank).where(F.col("rank") <= most)


def nearest_fingerprint(new: DataFrame, known: DataFrame, key: str, fingerprint: str, most: int) -> DataFrame:
    """(key, other, distance): for each row of ``new`` the known row with the nearest fingerprint within ``most`` (at most 3) bits,
    of equally near ones the smallest key. Fingerprints that are null or 0 match nothing."""
    mine = new.select(F.col(key), F.col(fingerprint).alias("f")).where("f is not null and f <> 0")
    probes = mine.select("f").distinct().select("f", F.posexplode(_keys(F.col("f"), NEAR_TABLES)).alias("table", "value"))
    theirs = _distinct(known, key, fingerprint)[0].select("id", F.col("f").alias("g"), F.posexplode(_keys(F.col("f"), NEAR_TABLES)).alias("table", "value"))
    apart = hamming(F.col("f"), F.col("g"))
    met = probes.join(theirs, ["table", "value"]).where(apart <= most).groupBy("f").agg(F.min(F.struct(apart.alias("distance"), "id")).alias("x"))
    return mine.join(met, "f").select(key, F.col("x.id").alias("other"), F.col("x.distance").alias("distance"))


def _distinct(rows: DataFrame, key: str, fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """(id, f) with the smallest key of each fingerprint, and the pairs (a, b, 0) of that key with the others."""
    rows = rows.select(F.col(key).alias("_id"), F.col(fingerprint).alias("_f")).where("_f is not null and _f <> 0")
    one = rows.groupBy(F.col("_f").alias("f")).agg(F.min("_id").alias("id"))
    same = rows.join(one, F.col("_f") == F.col("f")).where("_id > id")
    return one, same.select(F.col("id").alias("a"), F.col("_id").alias("b"), F.lit(0).alias("distance"))


def _meet(one: DataFrame, tables: list[int], least: int, most: int) -> DataFrame:
    cut = one.select("id", "f", F.posexplode(_keys(F.col("f"), tables)).alias("table", "value"))
    a = cut.select(F.col("id").alias("a"), F.col("f").alias("fa"), "table", "value")
    b = cut.select(F.col("id").alias("b"), F.col("f").alias("fb"), "table", "value")
    apart = hamming(F.col("fa"), F.col("fb"))
    pairs = a.join(b, ["table", "value"]).where((F.col("a") < F.col("b")) & (apart >= least) & (apart <= most))
    return pairs.select("a", "b", apart.alias("distance")).distinct()


def vector_duplicates(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """Of candidate ``pairs`` (a, b), those whose vectors (vec_id, embedding) reach ``least`` cosine: (a, b, similarity)."""
    a = vectors.select(F.col("vec_id").alias("a"), F.col("embedding").alias("ea"))
    b = vectors.select(F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))
    scored = pairs.join(a, "a").join(b, "b").select("a", "b", F.round(cosine(F.col("ea"), F.col("eb")), 6).alias("similarity"))
    return scored.where(F.col("similarity") >= least)


def nearest(pairs: DataFrame, value: str, largest: bool = False) -> DataFrame:
    """(id, best, value): for each id of ``pairs`` (a, b, value) on either side, the other one of least value, or of largest.

    Ties go to the smallest id, null values take no part.
    """
    pairs = pairs.where(F.col(value).isNotNull())
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("best"), value).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("best"), value))
    order = F.struct((-F.col(value) if largest else F.col(value)).alias("first"), "best")
    return both.groupBy("id").agg(F.min_by(F.struct("best", value), order).alias("x")).select("id", "x.best", f"x.{value}")


def semantic_verdict(pairs: DataFrame, vectors: DataFrame, least: float = 0.92) -> DataFrame:
    """(id, best, similarity): the most similar candidate of each id, where it reaches ``least``; only cosines above 0 count."""
    scored = vector_duplicates(pairs, vectors, -1.0).where("similarity > 0")
    return nearest(scored, "similarity", largest=True).where(F.col("similarity") >= least)
