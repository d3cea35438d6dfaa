"""The found rows against truth worked out another way, on whole tables of two sizes where that is quick enough."""

import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from inkstream.llm.catalog import QUERIES
from inkstream.llm.text import words
from inkstream.sources.tables import read_table

SMALL, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def shingle_sets(rows):
    out = {}
    for i, title, body in rows:
        w = words("\n".join(x for x in (title, body) if x))
        out[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    return out


def similar(sets):
    """All pairs with similarity of at least 0.6, of pairs that share a shingle at all."""
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = Counter()
    for ids in holders.values():
        shared.update(combinations(sorted(ids), 2))
    return {(a, b) for (a, b), n in shared.items() if n / (len(sets[a]) + len(sets[b]) - n) >= 0.6}


@pytest.fixture(scope="module")
def stories(spark):
    history = [tuple(r) for r in read_table(spark, SMALL, "articles").select("article_id", "title", "body").collect()]
    incoming = [tuple(r) for r in read_table(spark, SMALL, "incoming_articles").select("article_id", "title", "body").collect()]
    return history, incoming


def test_p5(spark, stories):
    want = similar(shingle_sets(stories[0]))
    assert want and {tuple(r) for r in QUERIES["p5_found"](spark, SMALL).collect()} == want


def test_p3(spark, stories):
    new, want = {i for i, _, _ in stories[1]}, {}
    for a, b in similar(shingle_sets(stories[0] + stories[1])):
        if b in new:
            want[b] = min(a, want.get(b, a))
    assert want and {r.article_id: r.original_id for r in QUERIES["p3_found"](spark, SMALL).collect()} == want


@pytest.mark.parametrize("place", [SMALL, LARGER])
def test_p8(spark, place):
    from inkstream.llm.text import WORDS

    runs = defaultdict(set)
    cut = lambda text: WORDS.findall((text or "").lower())
    for r in read_table(spark, place, "eval_items").select("item_id", "text").collect():
        w = cut(r.text)
        for k in range(len(w) - 9):
            runs[" ".join(w[k : k + 10])].add(r.item_id)
    want = set()
    for r in read_table(spark, place, "documents").select("doc_id", "text").toLocalIterator():
        w = cut(r.text)
        for k in range(len(w) - 9):
            want |= {(r.doc_id, i) for i in runs.get(" ".join(w[k : k + 10]), ())}
    assert want and {tuple(r) for r in QUERIES["p8_found"](spark, place).collect()} == want


COMMON = {"en": "the of and to in a said was for on that with", "fr": "le la les des et une un dans pour du que est au", "de": "der die das und ein eine den mit von im zu auf nach", "es": "el la los las y una un en por del que con al"}


def guess(text):
    """Language by script, and by common words."""
    bengali, latin = len(re.findall("[ঀ-৿]", text)), len(re.findall("[A-Za-z]", text))
    if bengali > latin:
        return "bn"
    found = re.findall(r"[^\W\d_]+", text.lower())
    votes = {k: sum(found.count(w) for w in v.split()) for k, v in COMMON.items()}
    best, second = sorted(votes.values())[-1], sorted(votes.values())[-2]
    return max(votes, key=votes.get) if best > second else None


@pytest.mark.parametrize("place", [SMALL, LARGER])
def test_p2(spark, place):
    """Articles and foreign paragraphs, against script and common words."""
    got = {(r.record_kind, r.record_key, r.para_no): r.lang for r in QUERIES["p2_found"](spark, place).collect()}
    wrong = total = 0
    names = {"bangla": "bn", "bengali": "bn", "ben": "bn", "english": "en", "eng": "en", "fra": "fr", "deu": "de", "spa": "es"}
    for r in read_table(spark, place, "articles").select("article_id", "language", "body").collect():
        parts = [p for p in re.split(r"\n\s*\n", r.body or "") if p.strip()]
        langs = [guess(p) for p in parts]
        weight = Counter()
        for p, x in zip(parts, langs):
            weight[x] += len(re.findall(r"[^\W\d_]", p))
        if not weight or None in langs:
            continue
        top = weight.most_common(1)[0][0]
        label = (r.language or "").strip().lower()
        label = names.get(label, label[:2])
        key = str(r.article_id)
        want = {("article", key, 0): top} if label != top else {}
        want |= {("segment", key, k): x for k, x in enumerate(langs, 1) if x != top}
        own = {k: got[k] for k in [("article", key, 0), *(("segment", key, k) for k in range(1, len(parts) + 1))] if k in got}
        total += len(want)
        wrong += len(set(want.items()) ^ set(own.items()))
    assert total > (50 if place == SMALL else 500) and wrong <= 0.03 * total, (wrong, total)
