"""One usual form for texts that look alike, and the words and shingles counted on it.

``usual_form`` gives NFC with plain spaces: no invisible characters, no compatibility variants that look like
their plain letters (full-width, bold or monospaced mathematical letters, ligatures), no look-alike letters of
another alphabet inside a word. What visibly differs stays: superscripts, circled signs, words wholly in another
alphabet, and the joiners that Bangla spelling needs. ``match_form`` folds case on top, for comparisons.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that look like a Latin letter, and that letter.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ё": "ë", "ї": "ï", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W",
    "Ё": "Ë", "Ї": "Ï",
    # Greek
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮪ": "S", "Ꮮ": "L",
    "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮩ": "V", "Ᏼ": "B",
    # Coptic
    "ⲟ": "o", "ⲥ": "c", "ⲣ": "p", "Ⲟ": "O", "Ⲥ": "C", "Ⲣ": "P", "Ⲏ": "H", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲧ": "T",
    # Lisu
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N",
    "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
}
# Sequences drawn like one letter, and that letter.
SEQUENCES = {"অা": "আ"}

_VIRAMA = "্्੍્୍்్್്"
# Code points that Unicode calls default-ignorable, without the two joiners and the variation selectors 15 and 16.
_IGNORABLE = (
    "­͏؜ᅟᅠ឴឵᠋-᠏​‎‏‪-‮⁠-⁯ㅤ"
    "︀-︍﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
)
_DROP = regex.compile(rf"[{_IGNORABLE}]+")
# A joiner has a place after a virama, between RA and the virama, or between two signs of an emoji sequence.
_STRAY_JOINER = regex.compile(
    rf"(?<![{_VIRAMA}])‌|(?<![{_VIRAMA}]|র(?=‍্)|[\p{{So}}\p{{Sk}}️](?=‍\p{{So}}))‍"
)
_STRAY_SELECTOR = regex.compile(r"(?<![\p{So}\p{Sm}\p{Po}\p{Nd}])[︎️]")
_SPACE = regex.compile(r"[\p{Zs}--[ ]]", flags=regex.V1)
_LINE = regex.compile(r"\r\n?|[\x0b\x0c\x85  ]")
_COMPAT = regex.compile(r"[ - ℀-⅏Ⅰ-ⅿ　ﬀ-ﬆ！-￮\U0001d400-\U0001d7ff]")
_OTHER = regex.compile(r"[Ͱ-ϿЀ-ԯԱ-֏ἀ-῿Ꭰ-ᏼⲀ-⳿ꓐ-ꓽ]")
_WORD_OTHER = regex.compile(r"[\p{L}\p{M}]*[\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}\p{Coptic}\p{Lisu}][\p{L}\p{M}]*")
_LATIN = regex.compile(r"\p{Latin}")
_LETTER_OTHER = regex.compile(r"[\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}\p{Coptic}\p{Lisu}]")
_SEQUENCE = regex.compile("|".join(map(regex.escape, SEQUENCES)))
# Anything that may need work; a text without a match is in its usual form already.
_SUSPECT = re.compile(
    rf"[{_IGNORABLE}‌‍︎️\x0b\x0c\r\x85     -   　"
    r"℀-⅏Ⅰ-ⅿﬀ-ﬆ！-￮\U0001d400-\U0001d7ffͰ-ϿЀ-ԯԱ-֏ἀ-῿Ꭰ-ᏼⲀ-⳿ꓐ-ꓽ]"
)
_ASCII_SUSPECT = re.compile(r"[\x0b\x0c\r]")
_KINDS = {"<font>", "<wide>", "<narrow>", "<compat>"}


@lru_cache(maxsize=4096)
def _plain(ch: str) -> str:
    """The plain counterpart of a compatibility variant that looks like it; other characters stay."""
    kind, _, rest = unicodedata.decomposition(ch).partition(" ")
    if kind not in _KINDS or unicodedata.category(ch)[0] in "S" and kind == "<compat>":
        return ch
    return "".join(_plain(chr(int(x, 16))) for x in rest.split())


def _latin_word(word: str, proven: bool) -> str:
    other = _LETTER_OTHER.findall(word)
    if any(c not in LOOKALIKES for c in other):
        return word
    if not proven and not _LATIN.search(word) and len({unicodedata.name(c).split()[0] for c in other}) < 2:
        return word
    return "".join(LOOKALIKES.get(c, c) for c in word)


def _without_lookalikes(text: str) -> str:
    """Words that mix alphabets become Latin. In a text that has such words, words made of look-alikes only do too."""
    out = _WORD_OTHER.sub(lambda m: _latin_word(m[0], False), text)
    return out if out == text else _WORD_OTHER.sub(lambda m: _latin_word(m[0], True), out)


def _suspect(text: str) -> bool:
    if text.isascii():
        return _ASCII_SUSPECT.search(text) is not None
    return _SUSPECT.search(text) is not None or any(x in text for x in SEQUENCES)


def usual_form(text: str) -> str:
    """``text`` in its usual form (see the module's docstring). Line breaks and repeated spaces stay."""
    if not _suspect(text):
        return text if text.isascii() else unicodedata.normalize("NFC", text)
    text = _LINE.sub("\n", text)
    text = _SPACE.sub(" ", text)
    text = _DROP.sub("", text)
    text = _STRAY_JOINER.sub("", text)
    text = _STRAY_SELECTOR.sub("", text)
    text = _COMPAT.sub(lambda m: _plain(m[0]), text)
    text = unicodedata.normalize("NFC", text)
    text = _SEQUENCE.sub(lambda m: SEQUENCES[m[0]], text)
    if _OTHER.search(text):
        text = _without_lookalikes(text)
    return unicodedata.normalize("NFC", text)


def match_form(text: str) -> str:
    """The usual form with full case folding and runs of white space as one space: the key for comparisons."""
    return unicodedata.normalize("NFC", " ".join(usual_form(text).casefold().split()))


def has_variants(text: str) -> bool:
    """Whether ``text`` holds a character or sequence that its usual form writes otherwise.

    Line breaks written in another way are no variant.
    """
    if "\r" in text or "\x0b" in text or "\x0c" in text or "\x85" in text or " " in text or " " in text:
        text = _LINE.sub("\n", text)
    if not _suspect(text) and unicodedata.is_normalized("NFC", text):
        return False
    return usual_form(text) != text


WORDS = regex.compile(r"[\p{L}\p{M}\p{Nd}‍]+")


_ASCII_WORDS = re.compile("[0-9a-z]+")
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(maxsize=1)
def _bmp_words() -> re.Pattern:
    """WORDS for texts of the basic plane: its characters there as one class of ``re``, which searches faster."""
    runs = (m.span() for m in WORDS.finditer("".join(map(chr, range(0x10000)))))
    return re.compile("[" + "".join(rf"\u{a:04x}-\u{b - 1:04x}" for a, b in runs) + "]+")


def words(text: str) -> list[str]:
    """The words of ``text`` in usual form: longest runs of letters, marks, digits and U+200D, lower-cased."""
    text = usual_form(text).lower()
    if text.isascii():
        return _ASCII_WORDS.findall(text)
    return (WORDS if _ASTRAL.search(text) else _bmp_words()).findall(text)


class WordHasher:
    """64-bit hashes of words, remembered up to a bound (then forgotten at once, so memory stays bounded)."""

    def __init__(self, most: int = 500_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for t in tokens:
                if t not in known:
                    known[t] = xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))
            return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` adjacent words, from word hashes; empty where the text is shorter."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, width):
        out = mix(out * _A + _B) + h[k : k + n] * _C
    return mix(out)


@F.pandas_udf(T.StringType())
def usual_form_udf(s: pd.Series) -> pd.Series:
    return _per_distinct(s, usual_form)


@F.pandas_udf(T.StringType())
def match_form_udf(s: pd.Series) -> pd.Series:
    return _per_distinct(s, match_form)


@F.pandas_udf(T.BooleanType())
def has_variants_udf(s: pd.Series) -> pd.Series:
    return _per_distinct(s, has_variants).astype("boolean")


def _per_distinct(s: pd.Series, f) -> pd.Series:
    """``f`` applied once to each distinct value of the batch; nulls stay null."""
    codes, values = pd.factorize(s)
    out = np.array([f(v) for v in values] + [None], dtype=object)
    return pd.Series(out[codes])


def normalise_columns(df: DataFrame, columns: list[str], fold_case: bool = False) -> DataFrame:
    """``df`` with the named text columns in usual form (or match form). Null stays null, '' stays ''."""
    f = match_form_udf if fold_case else usual_form_udf
    return df.withColumns({c: f(F.col(c)) for c in columns})


def variant_fields(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field_name) of each value of ``columns`` with at least one variant; nulls give no row."""
    flags = df.select(key, *[has_variants_udf(F.col(c)).alias(f"_v{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(f"_v{i}").alias("hit")) for i, c in enumerate(columns)])
    return flags.select(key, F.explode(pairs).alias("x")).where("x.hit").select(key, "x.field_name")


assert sys.byteorder == "little", "packed arrays of hashes are read as little-endian"
