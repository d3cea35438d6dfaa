"""Exact nearest neighbours and hybrid fusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def knn(vectors: DataFrame, query: list[float], k: int, where: str | None = None, least: float | None = None) -> DataFrame:
    """(vec_id, similarity) of the k nearest vectors, by similarity rounded to 6 places, then id.

    One pass of matrix products and a top-k per partition.
    """
    rows = vectors.where(where) if where else vectors
    near = scored(rows, query)
    if least is not None:
        near = near.where(F.col("similarity") >= least)
    return near.orderBy(F.desc("similarity"), "vec_id").limit(k)


def similar_to(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k nearest others of each stated query vector, exactly.

    ``queries`` (vec_id, embedding) is taken in blocks of about ``block`` vectors; a block is sent to the executors as one
    matrix and multiplied with each batch of ``vectors``. A batch passes on its own k best per query, so what is shuffled is
    batches x queries x k. Vectors of norm 0 have similarity 0; null vectors and vectors of another length are left out.
    """
    total = queries.count()
    blocks = total // block + 1
    out = None
    for n in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n)
        near = _nearest(vectors.select("vec_id", "embedding"), part.select("vec_id", "embedding").where("embedding is not null").collect(), k)
        out = near if out is None else out.unionByName(near)
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_articles(vectors: DataFrame, articles: DataFrame, query: list[float], k: int, slot: str | None = None) -> DataFrame:
    """(article_id, title, similarity) of the k nearest articles that are no duplicates, of vectors (vec_id, embedding) in a slot.

    ``slot``: a predicate that pins kind, model and version of the vectors; it is applied before the search. Vectors without an article
    take no part, so the join comes before the top k."""
    pinned = vectors.where(slot) if slot else vectors
    live = articles.where("duplicate_of is null").select(F.col("article_id").alias("vec_id"), "title")
    near = scored(pinned.select("vec_id", "embedding"), query)
    return near.join(live, "vec_id").orderBy(F.desc("similarity"), "vec_id").limit(k).select(F.col("vec_id").alias("article_id"), "title", "similarity")


def scored(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(vec_id, similarity) of every vector with ``query``, rounded to 6 places, a batch as one matrix product.

    Vectors of norm 0 have similarity 0; null vectors and those of another length are left out."""
    target = _unit(np.array([query], np.float64))[0]

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            fit = np.asarray(lists.value_lengths().fill_null(-1)) == len(target)
            kept = batch.filter(pa.array(fit))
            flat = kept.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(target))
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(np.round(_unit(flat) @ target, 6) + 0.0)], ["vec_id", "similarity"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, similarity double")


def _nearest(vectors: DataFrame, block: list, k: int) -> DataFrame:
    ids = np.array([r[0] for r in block], np.int64)
    dim = len(block[0][1]) if block else 0
    keep = [i for i, r in enumerate(block) if len(r[1]) == dim]
    ids, matrix = ids[keep], _unit(np.array([block[i][1] for i in keep], np.float64).reshape(len(keep), dim))
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))  # one block

    def run(batches):
        own, q = shared.value
        for batch in batches:
            rows = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if v is not None and len(v) == q.shape[1]]
            if not rows or not len(own):
                continue
            vec = np.array([i for i, _ in rows], np.int64)
            sim = np.round(q @ _unit(np.array([v for _, v in rows], np.float64)).T, 6) + 0.0
            sim[own[:, None] == vec[None, :]] = -2
            order = np.lexsort((np.broadcast_to(vec, sim.shape), -sim), axis=1)[:, :k]
            best = np.take_along_axis(sim, order, axis=1)
            some = best > -2
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(own, some.sum(axis=1))), pa.array(vec[order][some]), pa.array(best[some])], ["query_id", "vec_id", "similarity"]
            )

    return vectors.mapInArrow(run, "query_id long, vec_id long, similarity double")


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def hybrid(lexical: DataFrame, semantic: DataFrame, limit: int, strong: float = 0.5) -> DataFrame:
    """(id, score, kind) by class: title hits, strong semantic hits, body hits; an id counts once, in its best class.

    ``lexical``: (id, score), score 1.0 for title hits; ``semantic``: (id, score).
    """
    classed = lexical.select("id", "score", F.when(F.col("score") >= 1.0, 0).otherwise(2).alias("kind")).unionByName(
        semantic.where(F.col("score") >= strong).select("id", "score", F.lit(1).alias("kind"))
    )
    best = W.partitionBy("id").orderBy("kind", F.desc("score"))
    one = classed.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")
    return one.orderBy("kind", F.desc("score"), "id").limit(limit)
