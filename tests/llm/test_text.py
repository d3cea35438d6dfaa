"""Usual form of look-alike text (problem 6)."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstream.llm.text import has_variants, match_form, normalise_columns, usual_form, variant_fields, words


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Ｆｕｌｌ　ｗｉｄｔｈ，", "Full width,"),
        ("𝗯𝗼𝗹𝗱 ﬁsh ﬂood", "bold fish flood"),
        ("Sére", "Sére"),
        ("a​b﻿c⁠d­e", "abcde"),
        ("no break em x", "no break em x"),
        ("be‌k", "bek"),
        ("Βοassa mоnеу", "Boassa money"),
        ("অাম", "আম"),
        ("rꓳad ⲟne Ꮪtop", "rOad one Stop"),
        ("য় ড়", unicodedata.normalize("NFC", "য় ড়")),
    ],
)
def test_variants(raw, want):
    assert usual_form(raw) == want
    assert has_variants(raw)
    assert not has_variants(want)


@pytest.mark.parametrize(
    "text",
    ["", "plain", "ᎣᏏᏲ ⲡⲉⲥⲟⲛ ꓡꓲꓢꓴ", "492 km² ½ ①", "র‍্যালি", "ক্‌ষ", "(новости) (λιμάνι) (газета)", "l'été “quoted”…", "a\r\nb", "👨‍👩‍👧 ❤️", "x\n\ny  z", "naïve Ångelby"],
)
def test_no_case(text):
    assert not has_variants(text)


def test_look_alike_only_words_need_proof():
    assert usual_form("А стартап") == "А стартап"
    assert usual_form("А stаrtuр") == "A startup"


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_idempotent(text):
    once = usual_form(text)
    assert usual_form(once) == once
    assert unicodedata.is_normalized("NFC", once)
    assert not has_variants(once)


def test_words_and_match_form():
    assert words("The র‍্যালি, Ｎｏ．5–x²") == ["the", "র‍্যালি", "no", "5", "x"]
    assert match_form("  Straße A ") == match_form("STRASSE a")


def test_columns(spark):
    rows = [(1, "ｘ", None, "s"), (1, "ｘ", None, "s"), (2, None, "", "t"), (3, "a" * 200_000 + "​", "ok", "u")]
    df = spark.createDataFrame(rows, "id long, title string, body string, field_name string")
    got = sorted(map(tuple, variant_fields(df, "id", ["title", "body"]).collect()))
    assert got == [(1, "title"), (1, "title"), (3, "title")]
    assert variant_fields(df.limit(0), "id", ["title"]).count() == 0
    out = {r.id: (r.title, r.body, r.field_name) for r in normalise_columns(df, ["title", "body"]).collect()}
    assert out[1] == ("x", None, "s") and out[2] == (None, "", "t") and len(out[3][0]) == 200_000


def test_words_are_the_longest_runs_of_word_characters():
    from inkstream.llm.text import WORDS, usual_form, words

    for c in range(0x20000):
        text = f"A{chr(c)}b 1"
        assert words(text) == WORDS.findall(usual_form(text).lower()), hex(c)
