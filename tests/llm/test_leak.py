"""Leak search (problem 8) against brute force."""

import random

import pytest

from inkstream.llm.leak import PhraseSearch, PositionIndex, build_index, search_items
from inkstream.llm.text import WORDS


def tokens(text):
    return WORDS.findall((text or "").lower())


def brute(docs, items, n):
    runs = {}
    for i, t in items:
        w = tokens(t)
        for k in range(len(w) - n + 1):
            runs.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = tokens(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in runs.get(tuple(w[k : k + n]), ()) if d is not None and i is not None}
    return out


def leaked(docs, items, p):
    return search_items(build_index(docs, p), items, p)


@pytest.fixture(scope="module")
def tables():
    r = random.Random(3)
    v = [f"t{i}" for i in range(30)]
    items = [(i, " ".join(r.choices(v, k=r.choice([3, 9, 10, 11, 60])))) for i in range(20)] + [(50, None), (51, ""), (None, " ".join(v)), (0, " ".join(v[:10]))]
    docs = []
    for d in range(120):
        w = r.choices(v, k=r.choice([0, 5, 50, 200]))
        i, text = r.choice(items[:20])
        source = text.split()
        if d % 3 == 0 and len(source) > 10:
            a = r.randrange(len(source) - 9)
            w[len(w) // 2 : len(w) // 2] = source[a : a + r.choice([9, 10, 14])]
        docs.append((d, ", ".join(w).upper()))
    docs += [(200, None), (201, items[4][1] * 2), (None, items[4][1]), (7, docs[7][1]), (202, (items[19][1] + " ") * 2000)]
    return docs, items


@pytest.mark.parametrize("p", [PhraseSearch(), PhraseSearch(shard_docs=3, block_chars=400), PhraseSearch(length=4, shard_words=100)])
def test_matches_brute_force(spark, tables, p):
    docs, items = tables
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in leaked(d, i, p).collect()]
    want = brute(docs, items, p.length)
    assert len(got) == len(set(got)) and set(got) == want and want
    assert leaked(d.limit(0), i, p).count() == 0
    assert leaked(d, i.limit(0), p).count() == 0


def test_proximity(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    moved = words[:4] + ["extra", "word"] + words[4:]
    far = words[:4] + ["x"] * 5 + words[4:]
    swapped = [words[1], words[0], *words[2:]]
    docs = [(1, words), (2, moved), (3, far), (4, swapped), (5, words[:9])]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {r.doc_id for r in leaked(d, items, PhraseSearch(slop=2)).collect()}
    assert got == {1, 2, 4}
    assert {r.doc_id for r in leaked(d, items, PhraseSearch()).collect()} == {1}


def test_a_stored_index_serves_any_test_set(spark, tables, tmp_path):
    docs, items = tables
    d = spark.createDataFrame(docs, "doc_id long, text string")
    index = PositionIndex(spark, str(tmp_path / "i")).add(d.where("doc_id < 60 or doc_id is null"), 0)
    for _ in range(2):  # a label added again leaves the index as it was
        index.add(d.where("doc_id >= 60"), 1)
    again = PositionIndex(spark, str(tmp_path / "i"))
    for length, part in ((10, items), (4, items[:7]), (1, [(1, "t3"), (2, "nowhere")])):
        got = {(r.doc_id, r.item_id) for r in again.search(spark.createDataFrame(part, "item_id long, text string"), PhraseSearch(length=length)).collect()}
        assert got == brute(docs, part, length)
    with pytest.raises(ValueError):
        again.search(spark.createDataFrame(items, "item_id long, text string"), PhraseSearch(length=60, slop=10, gap=80))
    with pytest.raises(ValueError):
        PhraseSearch(length=100)
