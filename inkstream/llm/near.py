"""Near-duplicates by similarity of word shingles, over collections too large for pairwise comparison.

Every text becomes a ring of segments. Segment k holds the smallest value that hash function k gives to a shingle of the text
(a run of adjacent words in usual form), so two texts agree in a segment with a probability equal to their similarity,
whatever their length and however rare their words.

* Candidates are pairs with a chain: ``run`` consecutive segments of the ring without any difference. The number of segments
  follows from the threshold: a pair on the threshold has a chain but with probability ``miss`` (``segments``); pairs above it
  are missed less often still. A chain is one 64-bit key, so candidates come from one equality join.
* Texts that share common phrases meet in chains by chance, and such meetings grow with the square of the table. With ``more``, a
  chain counts only if enough of the segments after it agree too. Their values travel beside the key, so a chance meeting ends in
  the join that made it; the ring gets as many more segments as keep the probability of a miss where it was.
* The ring's bit fingerprint, 4 bits a segment, is then compared whole: pairs with a larger Hamming distance than a pair on
  the threshold has, but with probability ``miss`` (``most_bits``), are dropped.
* What is left goes to the exact comparison of the shingle sets.

Exact copies (the same shingle set) are one class; only one representative a class takes part in the joins.
Texts with fewer words than a shingle has no shingles and are never similar to anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm.text import WordHasher, mix, shingle_hashes, words
from inkstream.session import materialize

FEATURES = "id long, sig long, n int, sh array<int>, bits array<long>, ring binary"
KEYS = "key long, id long"
KEYS_AHEAD = "key int, ahead int, id long"  # with ``more``: keys may be shorter, as what lies ahead is compared as well
AHEAD, _AHEAD_BITS = 5, 6  # segments after a chain whose values, of so many bits each, go beside its key
_HASH = np.uint64(2**32 - 1)
_CHUNK = 512  # texts whose shingles are held as flat arrays at once
_CLASS = 1000  # members of a class that meet the class in one join key when copies are expanded


@dataclass(frozen=True)
class Similarity:
    """Parameters of a similarity search.

    width: words in a shingle. threshold: least Jaccard similarity. run: segments in a chain; longer ones make fewer chance
    candidates and need more segments. more: of the AHEAD segments after a chain, those that must agree too. miss: probability with which the chain, and the fingerprint, may miss a pair that lies
    just on the threshold. seed: of the hash functions.
    """

    width: int = 5
    threshold: float = 0.8
    run: int = 4
    miss: float = 1e-5
    seed: int = 5
    more: int = 0


def chainless(segments: int, run: int, p: float) -> float:
    """Probability that a ring of segments, each in agreement with probability p, has no ``run`` consecutive ones that agree."""
    total = 0.0
    for lead in range(min(run, segments)):  # segments in agreement before the first that differs
        state = np.zeros(run)  # by the length of the run so far
        state[0] = p**lead * (1 - p)
        for _ in range(segments - lead - 1):
            state = np.concatenate([[state.sum() * (1 - p)], state[:-1] * p])
        total += state[: run - lead].sum()
    return total


def unfollowed(segments: int, p: Similarity) -> float:
    """Probability that a row of segments, each in agreement with probability ``threshold``, has no ``run`` consecutive ones that
    agree with at least ``more`` of the AHEAD after them. A ring has these chains and those across its seam, so it is missed less often."""
    wide = p.run + AHEAD
    seen = np.arange(2**wide)  # agreement of the last segments, the latest in the lowest bit
    chain = (seen >> AHEAD) == 2**p.run - 1
    counts = chain & (np.bitwise_count(seen & (2**AHEAD - 1)) >= p.more)
    odds = p.threshold ** np.bitwise_count(seen) * (1 - p.threshold) ** (wide - np.bitwise_count(seen))
    state = np.where(counts, 0, odds)
    for _ in range(segments - wide):
        older = state.reshape(2, -1).sum(axis=0)  # by all but the earliest
        state = np.where(counts, 0, np.stack([older * (1 - p.threshold), older * p.threshold], axis=1).ravel())
    return float(state.sum())


@lru_cache
def segments(p: Similarity) -> int:
    """The fewest segments with which a pair on the threshold has a chain (with what must follow it) but with probability ``miss``."""

    def missed(size: int) -> float:
        return unfollowed(size, p) if p.more else chainless(size, p.run, p.threshold)

    low = p.run + AHEAD if p.more else p.run
    high = 2 * low
    while missed(high) > p.miss:
        low, high = high, 2 * high
        if high > 100_000:
            raise ValueError(f"no ring for a threshold of {p.threshold} and chains of {p.run}")
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if missed(middle) <= p.miss else (middle + 1, high)
    return low


@lru_cache
def most_bits(p: Similarity) -> int:
    """The Hamming distance of fingerprints that a pair on the threshold exceeds with at most probability ``miss``."""
    one = np.array([comb(4, d) / 16 * (1 - p.threshold) for d in range(5)])
    one[0] += p.threshold
    whole = np.ones(1)
    for _ in range(segments(p)):
        whole = np.convolve(whole, one)
    above = 1 - np.cumsum(whole)
    return int(np.argmax(above <= p.miss))


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    columns = [batch.column(i).to_pylist() for i in range(1, batch.num_columns)]
    for parts in zip(*columns):
        yield "\n".join(p for p in parts if p)


def _flat_shingles(texts: list[list[str]], hasher: WordHasher, p: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """(text, 32-bit shingle hash) of every text's set, laid end to end."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    sh = shingle_hashes(hasher([t for text in texts for t in text]), p.width)
    owner = np.repeat(np.arange(len(texts)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(owner))  # words from here to the end of the text
    whole = left[: len(sh)] >= p.width
    own = np.unique((owner[: len(sh)][whole].astype(np.uint64) << np.uint64(32)) | (sh[whole] >> np.uint64(32)))
    return (own >> np.uint64(32)).astype(np.int64), own & _HASH


def _rings(sh: np.ndarray, starts: np.ndarray, p: Similarity) -> np.ndarray:
    """(texts, segments) 16-bit segment values; ``sh``: the texts' shingles end to end, each text with at least one."""
    r = np.random.default_rng(p.seed)
    size = segments(p)
    odd = r.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    other = r.integers(0, 2**63, size, dtype=np.uint64)
    x = mix(sh)
    out = np.empty((len(starts), size), np.uint16)
    for k in range(size):
        out[:, k] = mix(np.minimum.reduceat((x ^ other[k]) * odd[k], starts)) & np.uint64(0xFFFF)
    return out


def _fingerprints(rings: np.ndarray) -> np.ndarray:
    """4 bits of every segment, in 64-bit words: (texts, words)."""
    wide = np.zeros((len(rings), -(-rings.shape[1] // 16) * 16), np.uint64)
    wide[:, : rings.shape[1]] = rings & np.uint16(15)
    return (wide.reshape(len(rings), wide.shape[1] // 16, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)


def features(docs: DataFrame, p: Similarity) -> DataFrame:
    """(id, sig, n, sh, bits, ring) of each text with a shingle. ``docs``: an id column, then text columns.

    sig is the same for the same shingle set. sh is the set as 32-bit hashes (of two texts with a thousand shingles each, one
    shared by chance is to be expected once in some 4,000 pairs). bits and ring: the fingerprint and the segments.
    """

    def run(batches):
        hasher = WordHasher()
        for whole in batches:
            for start in range(0, whole.num_rows, _CHUNK):
                batch = whole.slice(start, _CHUNK)
                ids = batch.column(0)
                text, sh = _flat_shingles([words(t) for t in _texts(batch)], hasher, p)
                n = np.bincount(text, minlength=len(ids))
                sig = np.zeros(len(ids), np.uint64)
                np.add.at(sig, text, mix(sh))
                keep = (n > 0) & ~np.asarray(ids.is_null())
                some = np.flatnonzero(keep)
                ends = np.cumsum([0, *n[some]]).astype(np.int32)
                flat = sh[keep[text]]
                rings = _rings(flat, ends[:-1], p) if len(some) else np.empty((0, segments(p)), np.uint16)
                prints = _fingerprints(rings)
                wide = np.arange(len(some) + 1, dtype=np.int32) * np.int32(prints.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(some)).cast(pa.int64()),
                        pa.array(mix(sig + n.astype(np.uint64))[some].view(np.int64)),
                        pa.array(n[some].astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.uint32).view(np.int32))),
                        pa.ListArray.from_arrays(pa.array(wide), pa.array(prints.ravel().view(np.int64))),
                        pa.array([r.tobytes() for r in rings], pa.binary()),
                    ],
                    ["id", "sig", "n", "sh", "bits", "ring"],
                )

    return docs.mapInArrow(run, FEATURES)


def chains(rings: DataFrame, p: Similarity) -> DataFrame:
    """(key, id): one key for each chain of the ring of ``rings`` (id, ring); (key, ahead, id) with what lies ahead if ``more`` asks for it."""
    schema = KEYS_AHEAD if p.more else KEYS

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            ring = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(ids), segments(p)).astype(np.uint64)
            key = np.broadcast_to(np.arange(ring.shape[1], dtype=np.uint64), ring.shape)
            for k in range(p.run):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.roll(ring, -k, axis=1))
            owner = pa.array(np.repeat(ids, ring.shape[1]))
            if p.more:
                part = (ring >> np.uint64(16 - _AHEAD_BITS)).astype(np.uint32)
                ahead = sum(np.roll(part, -p.run - k, axis=1) << np.uint32(_AHEAD_BITS * k) for k in range(AHEAD))
                short = (key >> np.uint64(32)).astype(np.uint32)
                flat = [pa.array(x.ravel().view(np.int32)) for x in (short, ahead)] + [owner]
            else:
                flat = [pa.array(key.ravel().view(np.int64)), owner]
            for at in range(0, len(owner), 65536):
                yield pa.RecordBatch.from_arrays([x.slice(at, 65536) for x in flat], [c.split()[0] for c in schema.split(", ")])

    return rings.select("id", "ring").mapInArrow(run, schema)


def meet(left: DataFrame, right: DataFrame, p: Similarity) -> DataFrame:
    """(a, b) of each meeting of chains; ``left``, ``right``: chains of the ids a and b."""
    if not p.more:
        return left.withColumnRenamed("id", "a").join(right.withColumnRenamed("id", "b"), "key").select("a", "b")
    x = left.select("key", F.col("ahead").alias("xa"), F.col("id").alias("a"))
    y = right.select("key", F.col("ahead").alias("xb"), F.col("id").alias("b"))
    differ = F.col("xa").bitwiseXOR(F.col("xb"))
    agree = sum((differ.bitwiseAND(F.lit((2**_AHEAD_BITS - 1) << _AHEAD_BITS * k)) == 0).cast("int") for k in range(AHEAD))
    return x.join(y, "key").where(agree >= p.more).select("a", "b")


def classes(feats: DataFrame) -> DataFrame:
    """(sig, id, n, bits, ring): one row per distinct shingle set, with its smallest id and that row's ring."""
    least = F.min_by(F.struct("n", "bits", "ring"), "id").alias("x")
    return feats.groupBy("sig").agg(F.min("id").alias("id"), least).select("sig", "id", "x.n", "x.bits", "x.ring")


def near_bits(pairs: DataFrame, left: DataFrame, right: DataFrame, p: Similarity) -> DataFrame:
    """The pairs (a, b) whose sizes allow the threshold and whose fingerprints are near enough.

    ``left``, ``right``: (id, n, bits) of the texts a and b stand for."""
    a = left.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("fa"))
    b = right.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("fb"))
    words_ = -(-segments(p) // 16)
    distance = sum(F.bit_count(F.col("fa")[k].bitwiseXOR(F.col("fb")[k])) for k in range(words_))
    t = p.threshold - 1e-9
    sizes = (F.col("na") >= F.col("nb") * t) & (F.col("nb") >= F.col("na") * t)
    return pairs.join(a, "a").join(b, "b").where(sizes & (distance <= most_bits(p))).select("a", "b")


def verify(pairs: DataFrame, left: DataFrame, right: DataFrame, p: Similarity) -> DataFrame:
    """(a, b, similarity): pairs with their exact similarity, where it reaches the threshold. ``left``, ``right``: (id, sh)."""
    a = left.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("a"), F.col("sh").alias("sa"))
    b = right.join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("b"), F.col("sh").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    sim = both / (F.size("sa") + F.size("sb") - both)
    checked = pairs.join(a, "a").join(b, "b").select("a", "b", sim.alias("similarity"))
    return checked.where(F.col("similarity") >= p.threshold - 1e-12)


def similar_classes(docs: DataFrame, p: Similarity) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, rep) of every text with shingles; links (a, b, similarity), a < b, between reps.

    ``docs``: ids, then text columns (null texts count as empty). Rows without id are left out; an id given twice stands
    for each of its texts.
    """
    feats = materialize(features(docs, p), "sets")
    reps = materialize(classes(feats), "classes")
    members = feats.select("id", "sig").join(reps.select("sig", F.col("id").alias("rep")), "sig").select("id", "rep").distinct()
    keys = chains(reps, p)
    pairs = keys.withColumnRenamed("id", "a").join(keys.withColumnRenamed("id", "b"), "key").where("a < b").select("a", "b").distinct()
    near = materialize(near_bits(pairs, reps, reps, p), "pairs")
    sets = feats.join(reps.select("sig", "id"), ["sig", "id"], "left_semi").select("id", "sh")
    return members, verify(near, sets, sets, p).distinct()


def class_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class, copies, links): each text with its class, the other texts of the class, and the texts of other classes
    that it is similar to. Copies are counted and not expanded."""
    size = members.groupBy("rep").agg(F.count("*").alias("size"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both.join(size.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("size").alias("links"))
    own = size.join(around, "rep", "left").select("rep", "size", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(own, "rep").select("id", F.col("rep").alias("class"), (F.col("size") - 1).alias("copies"), "links")


def connected_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, group): the smallest id of the texts that a chain of links or copies joins with it.

    ``members`` (id, rep) and ``links`` (a, b) as from ``similar_classes``. Labels fall to the smallest label around and then to
    that label's own label, so a chain shrinks by doubling steps; each round is a written table, and nothing but the number
    of changes comes to the driver.
    """
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = edges.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(64):  # far more rounds than chains of any length need
        around = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(around, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("further"))
        after = materialize(lower.join(jump, "label").select("id", F.col("further").alias("label"), "before"), "labels")
        labels = after.select("id", "label")
        if not after.where("label <> before").take(1):
            break
    else:
        raise RuntimeError("labels did not settle")
    named = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    return named.select("id", F.coalesce("label", "rep").alias("group"))


def similar_pairs(docs: DataFrame, p: Similarity) -> DataFrame:
    """Every pair (a, b) of ids, a < b, with similarity of at least the threshold, copies expanded.

    The members of a large class are spread over join keys, so no task meets more than ``_CLASS`` of them with one text."""
    members, links = similar_classes(docs, p)
    parts = members.groupBy("rep").agg(F.ceil(F.count("*") / _CLASS).cast("int").alias("parts"))
    spread = members.join(parts, "rep").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    left = spread.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    right = spread.select(F.col("rep").alias("b"), F.col("id").alias("y"), "part")
    links = links.select("a", "b").join(parts.withColumnRenamed("rep", "b"), "b")
    same = parts.select(F.col("rep").alias("a"), F.col("rep").alias("b"), "parts")
    met = links.select("a", "b", "parts").unionByName(same).select("a", "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = met.join(left, "a").join(right, ["b", "part"]).where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()
