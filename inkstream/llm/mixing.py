"""Mixing sources to target weights by tokens, interleaved by Pfair scheduling.

Sizes are tokens of a public tokenizer. The amount taken from each source follows its target share; a source is repeated
at most as often as its cap allows, and the mix is as large as the scarcest source permits (or as large as asked, when
capped sources leave their share to the others). A source's records stand in hash order; their running sizes come from
two-level prefix sums, so that no source is gathered in one task. The stream of each source is cut into blocks of equal size,
records that reach over the end of a block being split, and a Pfair schedule orders the blocks: block k of a source with weight w
may not start before slot floor(k / w) and must be placed before slot ceil((k + 1) / w); at each slot the released block with the
earliest deadline goes first. After every slot, what each source has in the mix is less than one block away from its share.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstream.session import materialize

# Fixed value: the pattern by which the tokenizer's vocabulary splits text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Mixing:
    """tokenizer: path of a tiktoken vocabulary that the driver can read; it is shipped to the executors. block_tokens: size of a
    block. period: slots after which the schedule repeats; shares are rounded to 1 / period. total_tokens: size of the mix, or None for the
    largest one with exact shares. most_targets: most sources with a target. bucket_rows: about how many records one task
    sums in order."""

    tokenizer: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    block_tokens: int = 8192
    period: int = 10_000
    total_tokens: int | None = None
    most_targets: int = 1000
    bucket_rows: int = 20_000


class TokenCounter:
    """Tokens of a text. A text's count is the sum over its pieces, and pieces repeat, so their counts are remembered."""

    def __init__(self, path: str, most: int = 300_000) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counter", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(PATTERN)
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, text: str) -> int:
        known, total = self.known, 0
        if len(known) > self.most:
            known.clear()
        for piece, n in Counter(self.pieces.findall(text)).items():
            size = known.get(piece)
            if size is None:
                size = known[piece] = len(self.encoding.encode_ordinary(piece))
            total += n * size
        return total


def token_sizes(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(id, source, tokens) of ``docs`` (id, source, text); null texts have 0 tokens."""
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = tokenizer.rpartition("/")[2]

    def run(batches):
        counter = None
        for batch in batches:
            counter = counter or TokenCounter(SparkFiles.get(name))
            n = [counter(t) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["id", "source", "tokens"])

    key = docs.schema[docs.columns[0]].dataType.simpleString()
    return docs.mapInArrow(run, f"id {key}, source string, tokens long")


def running_sizes(sizes: DataFrame, bucket_rows: int) -> DataFrame:
    """``sizes`` (id, source, tokens) with ``start``: the tokens of its source before the record, in hash order.

    Records of a source are spread over buckets by hash; a window runs within a bucket, and the buckets' sums, of which
    there is one for some ten thousand records, give each bucket its offset.
    """
    n = sizes.count()
    buckets = n // bucket_rows + 1
    h = F.xxhash64("id")
    rows = sizes.withColumn("_h", h).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)))
    sums = rows.groupBy("source", "_b").agg(F.sum("tokens").alias("_n"))
    before = W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("source", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("source", "_b").orderBy("_h", "id").rowsBetween(W.unboundedPreceding, -1)
    own = rows.withColumn("_inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return own.join(offsets, ["source", "_b"]).select("id", "source", "tokens", (F.col("_offset") + F.col("_inside")).alias("start"))


def quotas(targets: dict[str, tuple[float, int]], totals: dict[str, int], total: int | None) -> dict[str, int]:
    """Tokens to take from each source. ``targets``: share and most repeats; ``totals``: tokens there are.

    Sources without tokens drop out and the others' shares are scaled up. Without ``total`` the mix is the largest in which
    every share is exact. With it, a source that its cap stops short gives what is missing to the others in proportion.
    """
    there = {s: (w, r) for s, (w, r) in targets.items() if w > 0 and r > 0 and totals.get(s, 0) > 0}
    if not there:
        return {}
    weight = {s: w / sum(w for w, _ in there.values()) for s, (w, _) in there.items()}
    most = {s: totals[s] * r for s, (_, r) in there.items()}
    if total is None:
        total = int(min(most[s] / weight[s] for s in there))
    out: dict[str, int] = {}
    left, open_ = min(total, sum(most.values())), dict(weight)
    while open_:
        scale = left / sum(open_.values())
        full = [s for s in open_ if most[s] <= scale * open_[s]]
        if not full:
            return out | {s: int(round(scale * w)) for s, w in open_.items()}
        for s in full:
            out[s] = most[s]
            left -= most[s]
            del open_[s]
    return out


def slots(weights: dict[str, float], period: int) -> dict[str, list[int]]:
    """The slots of each source in one period of the Pfair schedule.

    Weights are rounded to 1 / period by largest remainders, each to at least one slot. Slots are given out one by one to
    the released block with the earliest deadline; ties go to the larger weight, then by name.
    """
    period = max(period, 10 * len(weights))
    total = sum(weights.values())
    share = {s: w / total * period for s, w in weights.items()}
    n = {s: max(1, int(x)) for s, x in share.items()}
    for s in sorted(share, key=lambda s: (n[s] - share[s], s)):
        if sum(n.values()) >= period:
            break
        n[s] += 1
    while sum(n.values()) > period:
        n[max(n, key=lambda s: (n[s] - share[s], n[s]))] -= 1
    while sum(n.values()) < period:
        n[max(n, key=lambda s: (share[s] - n[s], n[s]))] += 1
    out: dict[str, list[int]] = {s: [] for s in n}
    waiting = [(0, s) for s in n]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str]] = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(out[s]) + 1) * period // n[s]), -n[s], s))
        _, _, s = heapq.heappop(ready)
        out[s].append(t)
        if len(out[s]) < n[s]:
            heapq.heappush(waiting, (len(out[s]) * period // n[s], s))
    return out


def _targets(targets: DataFrame, p: Mixing) -> dict[str, tuple[float, int]]:
    """Share and cap by source; a source named twice has the sum of its shares and the larger cap; a null cap is 1."""
    rows = targets.where("source is not null and target_share > 0").groupBy("source")
    rows = rows.agg(F.sum("target_share").alias("w"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("r"))
    found = rows.limit(p.most_targets + 1).collect()
    if len(found) > p.most_targets:
        raise ValueError(f"more than {p.most_targets} sources have a target")
    return {r["source"]: (r["w"], r["r"]) for r in found}


def scheduled(quota: dict[str, int], most: dict[str, int], period: int) -> tuple[dict[str, int], dict[str, list[int]]]:
    """Quotas whose shares are those of the schedule, multiples of 1 / period, and its slots; no quota is above ``most``."""
    wanted = {s: q for s, q in quota.items() if q > 0}
    if not wanted:
        return {}, {}
    periods = slots(wanted, period)
    length = sum(map(len, periods.values()))
    total = min([sum(wanted.values()), *(most[s] * length / len(own) for s, own in periods.items())])
    return {s: int(total * len(own) / length) for s, own in periods.items()}, periods


def mix(docs: DataFrame, targets: DataFrame, p: Mixing) -> tuple[DataFrame, DataFrame]:
    """(records, shares) of the mix of ``docs`` (id, source, text) to ``targets`` (source, target_share, max_repeats).

    records: (slot, source, start, id, copy, offset, tokens), one row per use of a record and block; (slot, start) is the order of the
    mix, start the place in the source's stream, offset the first token of the record in this row. A record is split where a block
    ends, and a source's last one is cut at its quota.
    shares: (source, target_share, actual_share, tokens, uses, records, most_uses) for every target, 0 where it has nothing.
    Records without text, tokens or source are no part of a mix.
    """
    spark = docs.sparkSession
    wanted = _targets(targets, p)
    key = docs.columns[0]
    own = docs.where(F.col(docs.columns[1]).isin(list(wanted))) if wanted else docs.limit(0)
    sizes = materialize(token_sizes(own, p.tokenizer).where("tokens > 0"), "sizes")
    totals = {r["source"]: r["n"] for r in sizes.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # a row a target
    quota = quotas(wanted, totals, p.total_tokens)
    quota, periods = scheduled(quota, {s: totals[s] * wanted[s][1] for s in quota}, p.period)
    plan = spark.createDataFrame([(s, q, totals[s], len(periods[s])) for s, q in quota.items()], "source string, quota long, whole long, per_period long")
    table = spark.createDataFrame([(s, k, t) for s, own in periods.items() for k, t in enumerate(own)], "source string, k long, at long")
    length = sum(map(len, periods.values())) or 1
    started = running_sizes(sizes, p.bucket_rows).join(F.broadcast(plan), "source")  # a row a target
    copies = F.ceil((F.col("quota") - F.col("start")) / F.col("whole")).cast("int")
    uses = started.where(F.col("start") < F.col("quota")).withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    uses = uses.withColumn("start", F.col("start") + F.col("copy").cast("long") * F.col("whole"))
    uses = uses.withColumn("_end", F.least(F.col("start") + F.col("tokens"), "quota"))
    block = lambda c: F.floor(c / p.block_tokens)
    cut = uses.withColumn("_block", F.explode(F.sequence(block(F.col("start")), block(F.col("_end") - 1))))
    low = F.greatest("start", F.col("_block") * p.block_tokens)
    high = F.least("_end", (F.col("_block") + 1) * p.block_tokens)
    cut = cut.select("id", "source", "copy", "per_period", "_block", low.alias("start"), (low - F.col("start")).alias("offset"), (high - low).alias("tokens"))
    placed = cut.withColumn("k", F.pmod("_block", "per_period")).join(F.broadcast(table), ["source", "k"])  # a row a slot of one period
    slot = (F.floor(F.col("_block") / F.col("per_period")) * length + F.col("at")).alias("slot")
    records = placed.select(slot, "source", "start", F.col("id").alias(key), "copy", "offset", "tokens")
    return records, shares(records, wanted, key)


def shares(records: DataFrame, wanted: dict[str, tuple[float, int]], key: str) -> DataFrame:
    """What the mix came to, by source."""
    spark = records.sparkSession
    each = records.groupBy("source", key).agg(F.sum("tokens").alias("t"), F.count_if(F.col("offset") == 0).alias("n"))
    got = each.groupBy("source").agg(F.sum("t").alias("tokens"), F.sum("n").alias("uses"), F.count("*").alias("records"), F.max("n").alias("most_uses"))
    rows = spark.createDataFrame([(s, w) for s, (w, _) in wanted.items()], "source string, target_share double").join(got, "source", "left")
    rows = rows.na.fill(0, ["tokens", "uses", "records", "most_uses"])
    whole = F.sum("tokens").over(W.partitionBy(F.lit(1)))  # a row a target
    share = F.when(whole > 0, F.col("tokens") / whole).otherwise(F.lit(0.0)).alias("actual_share")
    return rows.select("source", "target_share", share, "tokens", "uses", "records", "most_uses")
