"""Mixing by Pfair scheduling (problem 9)."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstream.llm.mixing import PATTERN, Mixing, TokenCounter, mix, quotas, slots

TOKENIZER = Mixing.tokenizer
needs_tokenizer = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="tokenizer files are not there")


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.floats(0.001, 1), min_size=1, max_size=12))
def test_schedule_keeps_every_prefix_within_a_block(weights):
    period = 500
    got = slots(weights, period)
    length = sum(map(len, got.values()))
    assert sorted(t for own in got.values() for t in own) == list(range(length))
    for own in got.values():
        w, done = len(own) / length, set(own)
        taken = 0
        for t in range(length):
            taken += t in done
            assert abs(taken - w * (t + 1)) < 1


def test_quotas():
    targets = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 1), "none": (0.2, 3)}
    totals = {"a": 1000, "b": 100, "c": 1000}
    got = quotas(targets, totals, None)
    assert got == {"a": pytest.approx(333, abs=1), "b": pytest.approx(200, abs=1), "c": pytest.approx(133, abs=1)}
    more = quotas(targets, totals, 1500)
    assert more["b"] == 200 and more["a"] <= 1000 and sum(more.values()) == pytest.approx(1500, abs=2)
    assert quotas(targets, {}, None) == {} and quotas({}, totals, 5) == {}


@needs_tokenizer
def test_counts_equal_the_tokenizer():
    c = TokenCounter(TOKENIZER)
    for text in ("Hello  world, it's 2024!\n\n", "বাংলা লেখা ১২৩", "", "a" * 3000, "<|endoftext|> 👩‍👩"):
        assert c(text) == len(c.encoding.encode_ordinary(text))
    assert PATTERN


@needs_tokenizer
def test_mix(spark):
    rows = [(i, "big" if i % 3 else "small", f"word{i} " * (1 + i % 40), 0) for i in range(600)]
    rows += [(900, None, "x", 0), (901, "big", None, 0), (902, "big", "", 0), (903, "other", "text", 0), (904, "big", "huge " * 3000, 0), (1, "big", "word1 again", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, slot int").select("doc_id", "source", "text")
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.5, 3), ("gone", 0.1, 2), (None, 0.1, 1), ("null", None, 1)], "source string, target_share double, max_repeats int")
    p = Mixing(block_tokens=200, bucket_rows=50)
    records, report = mix(docs, targets, p)
    got = {r.source: r for r in report.collect()}
    assert abs(got["big"].actual_share - 4 / 9) < 0.03 and abs(got["small"].actual_share - 5 / 9) < 0.03
    assert got["gone"].tokens == 0 and got["small"].most_uses <= 3 and got["big"].most_uses <= 1 + 1
    assert abs(got["big"].actual_share - 4 / 9) < 1e-3
    out = records.collect()
    assert len({(r.source, r.start) for r in out}) == len(out)
    for s in ("big", "small"):  # records of a source follow each other without gaps
        own = sorted((r.start, r.tokens) for r in out if r.source == s)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    share = {s: sum(r.tokens for r in out if r.source == s) / sum(r.tokens for r in out) for s in ("big", "small")}
    blocks = {}
    for r in out:
        blocks.setdefault(r.slot, []).append((r.source, r.tokens))
    assert all(len({s for s, _ in b}) == 1 and sum(n for _, n in b) <= p.block_tokens for b in blocks.values())
    done, total = {"big": 0, "small": 0}, 0
    for slot in sorted(blocks):
        for s, n in blocks[slot]:
            done[s] += n
            total += n
        assert all(abs(done[s] - total * share[s]) < p.block_tokens for s in done)  # after every slot of the mix itself
    whole = {}  # the pieces of a use follow each other and make up the record, but for a source's last one
    for r in sorted(out, key=lambda r: (r.source, r.start)):
        assert r.offset == whole.get((r.source, r.doc_id, r.copy, r.start - r.offset), 0)
        whole[r.source, r.doc_id, r.copy, r.start - r.offset] = r.offset + r.tokens
    empty = mix(docs.limit(0), targets, p)
    assert empty[0].count() == 0 and empty[1].agg(F.sum("tokens")).first()[0] == 0
    assert mix(docs, targets.limit(0), p)[0].count() == 0
