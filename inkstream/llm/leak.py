"""Held-out test passages inside a large corpus: a sharded positional inverted index and phrase search on it.

The index is partitioned by documents. Each shard row holds, for some thousand documents, every term's posting list:
the positions of the term in the shard, documents laid end to end with a gap between them. It knows nothing of the test texts, so it
is stored once, extended by new documents, and searched by any test set (``PositionIndex``). A phrase is looked up term
by term from its rarest one: each list is shifted by the term's offset and intersected with what is left, so a phrase
costs about its shortest list. With a slop the same walk gives proximity matches: each word near its place. Shards are searched where
they lie; nothing is shuffled but the matches.

Words are longest runs of letters, combining marks, digits and U+200D, lower-cased. Null and wordless texts match
nothing, as do passages shorter than the phrase length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.llm.text import WORDS, WordHasher

INDEX_SCHEMA = "terms array<long>, starts array<int>, positions array<int>, doc_ids array<long>, doc_starts array<int>"


@dataclass(frozen=True)
class PhraseSearch:
    """length: words in a row that make a match. slop: how many places a word may stand off its place beside the rarest
    word of its run (0: exact phrases). gap: empty positions between documents of a shard (at least the
    length and the slop, so no phrase crosses). shard_docs, shard_words: a shard ends at whichever comes first; a longer document
    is a shard of its own. block_chars: test text handled at once; a larger test set is searched in blocks."""

    length: int = 10
    slop: int = 0
    gap: int = 64
    shard_docs: int = 4096
    shard_words: int = 500_000
    block_chars: int = 8_000_000

    def __post_init__(self) -> None:
        if self.length < 1 or self.slop < 0 or self.gap < self.length + self.slop:
            raise ValueError("the gap between documents must be at least the length of a phrase and its slop")


def _tokens(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def _shard(ids: list[int], docs: list[np.ndarray], gap: int) -> tuple[np.ndarray, ...]:
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    begins = np.concatenate([[0], np.cumsum(lengths + gap)[:-1]])
    flat = np.concatenate(docs)
    at = np.repeat(begins - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(len(flat))
    order = np.argsort(flat, kind="stable")
    terms, first = np.unique(flat[order], return_index=True)
    return terms.view(np.int64), np.append(first, len(flat)), at[order], np.array(ids, np.int64), begins


def build_index(docs: DataFrame, p: PhraseSearch) -> DataFrame:
    """Shard rows (``INDEX_SCHEMA``) of ``docs`` (id, text), with postings of every word. Null ids and wordless texts have no place."""

    def run(batches):
        hasher = WordHasher()
        ids: list[int] = []
        held: list[np.ndarray] = []
        words = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not text:
                    continue
                h = hasher(_tokens(text))
                if not len(h):
                    continue
                if held and (len(held) >= p.shard_docs or words + len(h) > p.shard_words):
                    yield _row(_shard(ids, held, p.gap))
                    ids, held, words = [], [], 0
                ids.append(i)
                held.append(h)
                words += len(h) + p.gap
        if held:
            yield _row(_shard(ids, held, p.gap))

    return docs.mapInArrow(run, INDEX_SCHEMA)


def _row(shard: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    kinds = [np.int64, np.int32, np.int32, np.int64, np.int32]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(k, copy=False))) for x, k in zip(shard, kinds)]
    return pa.RecordBatch.from_arrays(lists, ["terms", "starts", "positions", "doc_ids", "doc_starts"])


class Phrases:
    """All runs of ``length`` words in the test texts, each distinct run once with the items that hold it."""

    def __init__(self, items: list[tuple[int, str]], length: int) -> None:
        hasher = WordHasher()
        runs: dict[bytes, set[int]] = {}
        for item, text in items:
            if item is None or not text:
                continue
            h = hasher(_tokens(text))
            for s in range(len(h) - length + 1):
                runs.setdefault(h[s : s + length].tobytes(), set()).add(item)
        self.length = length
        self.vocabulary = np.unique(np.frombuffer(b"".join(runs), np.uint64)) if runs else np.empty(0, np.uint64)
        terms = np.frombuffer(b"".join(runs), np.uint64).reshape(-1, length)
        self.terms = np.searchsorted(self.vocabulary, terms)  # (runs, length), places in the vocabulary
        self.items = [sorted(x) for x in runs.values()]

    def search(self, terms: np.ndarray, starts: np.ndarray, positions: np.ndarray, slop: int) -> Iterator[tuple[int, np.ndarray]]:
        """(run, positions of its rarest word) of each run that stands in the shard, every word within ``slop`` of its place."""
        if not len(self.terms) or not len(terms):
            return
        at = np.minimum(np.searchsorted(terms, self.vocabulary), len(terms) - 1)
        there = terms[at] == self.vocabulary
        begin = starts[at]
        size = np.where(there, starts[at + 1] - begin, 0)
        sizes = size[self.terms]
        for r in np.flatnonzero(sizes.min(axis=1) > 0):
            rarest, *others = np.argsort(sizes[r], kind="stable")
            t = self.terms[r, rarest]
            left = positions[begin[t] : begin[t] + size[t]]
            for k in others:
                t = self.terms[r, k]
                own = positions[begin[t] : begin[t] + size[t]]
                want = left + (k - rarest)
                first = np.searchsorted(own, want - slop)
                near = own[np.minimum(first, len(own) - 1)]
                left = left[(near >= want - slop) & (near <= want + slop)]
                if not len(left):
                    break
            if len(left):
                yield int(r), left


def search_index(index: DataFrame, phrases: Phrases, slop: int = 0) -> DataFrame:
    """(doc_id, item_id, matches): in how many places the document holds runs of the item."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)  # one block of test text

    def run(batches):
        own = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                terms, starts, positions, ids, begins = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in range(5))
                hits: dict[tuple[int, int], int] = {}
                for r, where in own.search(terms.view(np.uint64), starts, positions, slop):
                    docs, n = np.unique(np.searchsorted(begins, where, side="right") - 1, return_counts=True)
                    for d, c in zip(docs.tolist(), n.tolist()):
                        for item in own.items[r]:
                            hits[d, item] = hits.get((d, item), 0) + c
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(ids[d]) for d, _ in hits], pa.int64()),
                        pa.array([i for _, i in hits], pa.int64()),
                        pa.array(list(hits.values()), pa.int64()),
                    ],
                    ["doc_id", "item_id", "matches"],
                )

    return index.mapInArrow(run, "doc_id long, item_id long, matches long")


def search_items(index: DataFrame, items: DataFrame, p: PhraseSearch) -> DataFrame:
    """(doc_id, item_id, matches) of each indexed document and test item (id, text) that share at least ``p.length`` words in a row.

    The test set is handled in blocks of about ``block_chars``, each with one pass over the index."""
    a, b = items.columns[:2]
    chars = items.agg(F.coalesce(F.sum(F.length(b)), F.lit(0))).first()[0]
    blocks = int(chars // p.block_chars) + 1
    found = None
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64(a), F.lit(blocks)) == k)
        phrases = Phrases([tuple(r) for r in part.select(a, b).collect()], p.length)  # at most about block_chars of text
        hits = search_index(index, phrases, p.slop)
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("doc_id", "item_id").agg(F.sum("matches").alias("matches"))


class PositionIndex:
    """A stored index of training documents in the folder ``path`` (a shared one); documents are added under a label, once each.

    The gap is fixed for the index: it can be searched for phrases up to it. Adding a label again replaces what stands under it."""

    def __init__(self, spark: SparkSession, path: str, p: PhraseSearch = PhraseSearch()) -> None:
        self.spark, self.path, self.p = spark, path.rstrip("/"), p

    def add(self, docs: DataFrame, label: int = 0) -> PositionIndex:
        build_index(docs, self.p).write.mode("overwrite").parquet(f"{self.path}/label={int(label)}")
        return self

    def shards(self) -> DataFrame:
        return self.spark.read.schema(f"{INDEX_SCHEMA}, label int").parquet(self.path).drop("label")

    def search(self, items: DataFrame, p: PhraseSearch | None = None) -> DataFrame:
        """(doc_id, item_id, matches) as from ``search_items``; ``p`` may have another length and slop, within the index's gap."""
        p = p or self.p
        if p.length + p.slop > self.p.gap:
            raise ValueError(f"the index has a gap of {self.p.gap} positions between documents")
        return search_items(self.shards(), items, p)
