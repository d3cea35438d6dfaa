"""Compression screening (problem 10): separation on held-out text, odd input."""

import random

import numpy as np
import pytest
import zstandard

from inkstream.llm.screen import CATEGORIES, ScreenFit, _cuts, categories, fit_screen, labelled_texts, rates, score_documents, windows


def corpus(n, seed):
    r = random.Random(seed)
    name = lambda: "".join(r.choices("bdfgklmnprst", k=1) + r.choices("aeiou", k=1)).title() + r.choice(["nam", "lor", "ves"])
    plain = [lambda: f"The council of {name()} approved a bridge near {name()} on {r.randrange(30)} May.", lambda: f"Police in {name()} stopped {r.randrange(90)} lorries.", lambda: f'"We lost the first set," said {name()} of {name()}.']
    bad = [
        [lambda: f"Hey {name()}, you are a stinking idiot and nobody likes you!", lambda: f"Shut your mouth {name()}, go crawl under a rock!!"],
        [lambda: f"The {name()} people are vermin and should be driven out of {name()}.", lambda: f"No {name()} family belongs here, throw them all out."],
        [lambda: f"Private show tonight with naked models in {name()}, pay and join.", lambda: f"Hot uncensored bedroom tapes from {name()}, adults only."],
    ]
    out = []
    for i in range(n):
        y = [0, 0, 0]
        s = [r.choice(plain)() for _ in range(r.randrange(3, 9))]
        if i % 4 == 0:
            k = i // 4 % 3
            y[k] = 1
            s.insert(r.randrange(len(s)), r.choice(bad[k])())
        out.append((" ".join(s), tuple(y)))
    return out


@pytest.fixture(scope="module")
def screen():
    return fit_screen(corpus(400, 1), ScreenFit())


def test_every_dictionary_is_trained(screen):
    for raw in (screen.ordinary, *(screen.toxic[c] for c in CATEGORIES)):
        assert raw and zstandard.ZstdCompressionDict(raw).dict_id() != 0


def test_thresholds_lie_where_the_kinds_come_apart():
    scores = np.array([[0.01, 0.0, 0.0]] * 50 + [[0.4, 0.0, 0.02]] * 30 + [[0.0, 0.5, 0.0]] * 2 + [[0.02, 0.01, 0.01]] * 5)
    labels = np.array([[0, 0, 0]] * 50 + [[1, 0, 0]] * 30 + [[0, 1, 0]] * 2 + [[1, 0, 0]] * 5)  # the last are mislabelled
    cuts = _cuts(scores, labels, ScreenFit())
    assert 0.02 < cuts[0] < 0.4 and 0.02 < cuts[1] < 0.5 and cuts[2] > 0.02
    assert all(0 < c <= 1 for c in _cuts(np.zeros((0, 3)), np.zeros((0, 3)), ScreenFit()))


def test_windows_join_disguised_words():
    assert windows("You are an i d i o t and a scummmbag, id.iot! 12 😡", 5) == ["you are an idiot and a scumbag, idiot!", "0"]
    assert windows("", 5) == [] and windows("\n \n", 5) == []


def test_held_out(spark, screen):
    test = corpus(200, 2)
    rows = [(i, t) for i, (t, _) in enumerate(test)] + [(900, None), (901, ""), (902, "z" * 200_000), (None, "x"), (0, test[0][0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = score_documents(docs, screen, ScreenFit())
    assert scores.count() == len(rows)
    got = {(r.id, r.category) for r in categories(scores, screen).collect()}
    want = {(i, c) for i, (_, y) in enumerate(test) for c, v in zip(CATEGORIES, y) if v}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(want)
    assert score_documents(docs.limit(0), screen, ScreenFit()).count() == 0


def test_few_labels_do_not_crash(spark):
    docs = spark.createDataFrame([(1, "a text", "s"), (2, None, "s"), (3, "b", None)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, None, 1, 0), (1, 0, 1, 0), (9, 1, 1, 1), (None, 1, 1, 1)], "doc_id long, abusive int, hateful int, sexual int")
    rows = labelled_texts(docs, labels, ScreenFit())
    assert rows == [("a text", (0, 1, 0))]
    for given in (rows, []):
        s = fit_screen(given, ScreenFit())
        found = categories(score_documents(docs.select("doc_id", "text"), s, ScreenFit()), s)
        assert rates(found.select("id", "category"), docs.select("doc_id", "source")).count() == 2
