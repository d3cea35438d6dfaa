"""Main body by minimum cut (problem 1)."""

import itertools
import random

import pytest

from inkstream.llm import boilerplate
from inkstream.llm.boilerplate import CutFit, blocks, content, fit_classifier, min_cut, page_bodies, sample_pages


def cost(side, gain, edges):
    return sum(-g for g, s in zip(gain, side) if s) + sum(w for a, b, w in edges if side[a] != side[b])


@pytest.mark.parametrize("seed", range(40))
def test_min_cut_is_minimal(seed):
    r = random.Random(seed)
    n = r.randrange(1, 9)
    gain = [r.choice([0, 0.5, r.uniform(-2, 2)]) for _ in range(n)]
    edges = [(*sorted(r.sample(range(n), 2)), r.uniform(0, 1.5)) for _ in range(r.randrange(0, 14))] if n > 1 else []
    best = min(cost(s, gain, edges) for s in itertools.product([False, True], repeat=n))
    assert cost(min_cut(gain, edges), gain, edges) == pytest.approx(best, abs=1e-9)


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks():
    assert texts("<div><p>a&nbsp;<b>b</b>\n c<p>d</div>e") == ["a b c", "d", "e"]
    assert texts("<td>x<br><br>y<br>z<br>\n<br>w</td>") == ["x", "yz", "w"]
    assert texts('<script>var q="<p>no</p>";</script><p>yes</p><!-- <p>no</p> --><style>p{}</style>') == ["yes"]
    assert texts("<ul><li>a<li>b</ul><P ALIGN=left><FONT SIZE=3>c</FONT></P>") == ["a", "b", "c"]
    assert texts("") == [] and texts("plain") == ["plain"] and texts("<p>unclosed <b") == ["unclosed <b"]
    assert len(texts("<p>" + "word " * 100_000 + "</p>")) == 1


def pages():
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefgh", k=9))
    out = []
    for i in range(60):
        body = [f"Sentence of {word()} tells what happened in {word()}. It goes on." for _ in range(r.randrange(2, 6))]
        side = f"Teaser {word()} about another thing that happened. It goes on too."
        page = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Head</h1><div class=by>By X</div>" + "".join(f"<p>{p}</p>" for p in body)
        out.append((i, f"s{i % 2}", page + f"</article><aside><div class=card><p>{side}</p></div></aside><footer><p>All rights reserved.</p></footer></body></html>", body))
    return out


def test_learns_from_extracted_bodies(spark):
    rows = pages()
    table = spark.createDataFrame([(i, s, p, "x") for i, s, p, _ in rows] + [(0, "s0", rows[0][2], "x"), (98, None, None, None), (None, "s", "", None)], "page_id long, source string, page string, body string")
    extracted = spark.createDataFrame([(i, "Share this\n" + "\n\n".join(b) + "\nAll rights reserved.", "s") for i, _, _, b in rows[:40]] + [(50, None, None)], "page_id long, body string, source string")
    classifier = fit_classifier(sample_pages(table, extracted, CutFit()), CutFit())
    got = {r.page_id: r.paragraphs for r in page_bodies(table.select("page_id", "page"), classifier).collect()}
    assert all(got[i] == b for i, _, _, b in rows)
    assert got[98] == [] and got[None] == []
    assert page_bodies(table.select("page_id", "page").limit(0), classifier).count() == 0


def test_without_sample(spark):
    empty = spark.createDataFrame([], "page_id long, source string, page string")
    bodies = spark.createDataFrame([], "page_id long, body string")
    classifier = fit_classifier(sample_pages(empty, bodies, CutFit()), CutFit())
    assert content("<p>text</p>", classifier, {}) == []


def test_lines_are_counted_over_all_records(spark):
    rare = "Follow the paper on its other pages."
    fit = CutFit(sample_pages=60)
    rows = [(i, "s", f"<p>Own text {chr(97 + i % 26)}{chr(97 + i // 26)}.</p><p>{rare if i % 25 == 0 else 'x'}</p>") for i in range(600)]
    table = spark.createDataFrame(rows, "page_id long, source string, page string")
    bodies = [(i, f"Own text {chr(97 + i % 26)}{chr(97 + i // 26)}." + (f"\n{rare}" if i % 25 == 0 else "")) for i in range(600)]
    got = sample_pages(table, spark.createDataFrame(bodies, "page_id long, body string"), fit)
    held = [(page, body) for _, page, body in got if rare in page]
    assert 0 < len(held) < 3 * 60 / 25 and all(body.startswith("Own text") and rare not in body for _, body in held)


def templates(count, seed):
    """Pages each in a template of its own, whose class names tell nothing; three sections of the article and three of teasers. Some of the
    paragraphs are short notes, some of the teasers whole sentences. Blocks of one section belong together."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=7))
    long = lambda: f"The {word()} of {word()} went on for {r.randrange(90)} days. Then it {word()} again."
    short = lambda: f"{word()} {word()}"
    out = []
    for i in range(count):
        own, parts = [], []
        for k in range(6):
            kinds = (short, long) if k % 2 else (long, short)
            texts_ = [kinds[r.random() < 0.15]() for _ in range(r.randrange(3, 7))]
            own += [] if k % 2 else texts_
            parts.append(f"<section class=c{word()}>{''.join(f'<p>{x}</p>' for x in texts_)}</section>")
        r.shuffle(parts)
        out.append((f"s{i}", f"<html><body>{''.join(parts)}</body></html>", "\n".join(own)))
    return out


def test_the_cut_mends_what_the_classifier_alone_gets_wrong(monkeypatch):
    flows = []
    flow = boilerplate._source_side
    monkeypatch.setattr(boilerplate, "_source_side", lambda *a: flows.append(1) or flow(*a))
    classifier = fit_classifier(templates(150, 1), CutFit(features=2**16))  # so that the class names of one page do not pass for those of others
    assert classifier.scale > 0 and classifier.edges["same"] > 0
    sign = cut = total = 0
    for _, page, body in templates(100, 2):
        own, found = set(body.split("\n")), blocks(page)
        odds = classifier.log_odds(found, {})
        side = min_cut(odds, classifier.smoothness(found))
        total += len(found)
        sign += sum((o > 0) != (b.text in own) for o, b in zip(odds, found))
        cut += sum(c != (b.text in own) for c, b in zip(side, found))
    assert flows and sign > 0.08 * total and cut < 0.7 * sign, (sign, cut, total)


def test_a_page_of_fifty_thousand_blocks():
    r = random.Random(3)
    gain = [r.uniform(-1, 1) for _ in range(50_000)]
    edges = [(i, i + 1, 0.8) for i in range(49_999)] + [(i, i + 2, 0.4) for i in range(49_998)]
    side = min_cut(gain, edges)
    for i in r.sample(range(1, 49_999), 300):  # no single change is cheaper
        flipped = (side[i] and gain[i] or -gain[i]) + sum(w * (1 if side[a + b - i] == side[i] else -1) for a, b, w in edges[max(0, i - 1) : i + 1] + edges[49_999 + max(0, i - 2) : 49_999 + i + 1] if i in (a, b))
        assert flipped >= -1e-9
