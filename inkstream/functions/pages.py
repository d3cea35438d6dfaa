"""Article fields of web pages: linked data as variants, OpenGraph by patterns, the rest by simple selectors."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Schema.org types that mark an article.
ARTICLE_TYPES = ("NewsArticle", "Article", "BlogPosting", "ReportageNewsArticle")
_SCRIPT = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"


@F.pandas_udf(T.StringType())
def unescape_udf(s: pd.Series) -> pd.Series:
    """All entities decoded; null stays null."""
    return s.map(lambda x: html.unescape(x) if x and "&" in x else x)


def plain_text(page: Column) -> Column:
    """Entities decoded, tags as a space, runs of spaces and tabs as one, trimmed; line breaks stay. Null gives ''."""
    bare = F.regexp_replace(unescape_udf(F.coalesce(page, F.lit(""))), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, "[ \\t]+", " "))


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def _text(v: Column) -> Column:
    """The text of a variant that is a string, trimmed; null for an empty one and for any other kind."""
    return F.when(F.schema_of_variant(v) == "STRING", F.nullif(F.trim(F.try_variant_get(v, "$", "string")), F.lit("")))


def _members(v: Column) -> Column:
    """The members of a list, and of lists in it; anything else is a list of itself. Null gives an empty list."""

    def once(x: Column) -> Column:
        return F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))

    return F.when(v.isNull(), F.array().cast("array<variant>")).otherwise(F.flatten(F.transform(once(v), once)))


def _present(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def _names(v: Column) -> Column:
    """The names of a person, given as text or as an object, or of several, joined by a comma."""
    found = _present(F.transform(_members(v), lambda x: F.coalesce(_text(x), _text(_field(x, "name")))))
    return F.nullif(F.array_join(found, ", "), F.lit(""))


def _strings(v: Column) -> Column:
    """Texts cut at commas, and the addresses of objects, in order."""

    def parts(x: Column) -> Column:
        cut = F.filter(F.transform(F.split(_text(x), ","), lambda p: F.trim(p)), lambda p: p != "")
        return F.coalesce(cut, _present(F.array(_text(_field(x, "url")))))

    return F.flatten(F.transform(_members(v), parts))


def linked_data(page: Column) -> Column:
    """Array of the article objects in a page's JSON-LD, in order: top-level ones, members of lists, and the members of a
    graph before the object that holds it. Scripts that are no JSON are skipped; a null page has none."""
    scripts = F.transform(F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(_SCRIPT), F.lit(1)), lambda s: F.try_parse_json(s))
    tops = F.flatten(F.transform(_present(scripts), _members))
    objects = F.flatten(F.transform(tops, lambda v: F.concat(_members(_field(v, "@graph")), F.array(v))))

    def is_article(v: Column) -> Column:
        kinds = F.transform(_members(_field(v, "@type")), _text)
        return F.coalesce(F.arrays_overlap(_present(kinds), F.array(*[F.lit(x) for x in ARTICLE_TYPES])), F.lit(False))

    return F.filter(objects, is_article)


def ld_fields(v: Column) -> Column:
    """The fields of an article object; null and empty lists where it lacks them. The body comes as it stands."""
    section = F.get(_members(_field(v, "articleSection")), F.lit(0))
    page = _field(v, "mainEntityOfPage")
    return F.struct(
        F.coalesce(_text(_field(v, "headline")), _text(_field(v, "name"))).alias("title"),
        _text(_field(v, "alternativeHeadline")).alias("subtitle"),
        _text(_field(v, "description")).alias("summary"),
        _names(_field(v, "author")).alias("author"),
        _text(_field(v, "datePublished")).alias("published_at"),
        _text(_field(v, "dateModified")).alias("updated_at"),
        _text(_field(v, "articleBody")).alias("body"),
        _text(section).alias("category"),
        _strings(_field(v, "keywords")).alias("tags"),
        _strings(_field(v, "image")).alias("image_urls"),
        F.coalesce(_text(_field(v, "url")), _text(_field(page, "@id")), _text(page)).alias("canonical_url"),
    )


_INSIDE = r"""(?:[^<>"']|"[^"]*"|'[^']*')*?"""


def _attribute(page: Column, tag: str, name: str, value: str, wanted: str) -> Column:
    """Attribute ``wanted`` of the first ``tag`` whose attribute ``name`` is ``value``, in either order and either quotes."""
    given = rf"""\s{name}\s*=\s*["']{value}["']"""
    pattern = rf"""(?is)<{tag}\b(?={_INSIDE}{given}){_INSIDE}\s{wanted}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    found = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(page, pattern, k)), F.lit("")) for k in (1, 2)])
    return unescape_udf(found)


def opengraph(page: Column) -> Column:
    """The OpenGraph fields of a page; the address falls back to rel=canonical."""

    def meta(name: str) -> Column:
        return _attribute(page, "meta", "property", name, "content")

    return F.struct(
        meta("og:title").alias("title"), meta("og:description").alias("summary"), meta("article:published_time").alias("published_at"),
        meta("article:modified_time").alias("updated_at"), meta("article:section").alias("category"), meta("og:image").alias("image"),
        F.coalesce(meta("og:url"), _attribute(page, "link", "rel", "canonical", "href")).alias("canonical_url"),
    )


@dataclass(frozen=True)
class Selectors:
    """For each field, selectors to try in order: element names with .class, #id or [attribute], each inside the one before it;
    at the end ``::text`` (the element's text) or ``::attr(name)``. body selects paragraphs."""

    title: tuple[str, ...] = ("h1::text",)
    subtitle: tuple[str, ...] = ()
    author: tuple[str, ...] = ()
    published_at: tuple[str, ...] = ("time::attr(datetime)",)
    category: tuple[str, ...] = ()
    body: tuple[str, ...] = ("article p::text",)
    images: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()


# Elements without content, and elements whose text is not shown.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset(("script", "style", "template", "noscript"))
_STEP = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[\w-]+\])*)$")


class _Selector:
    def __init__(self, text: str) -> None:
        path, _, pick = text.partition("::")
        self.attribute = pick[5:-1] if pick.startswith("attr(") else None
        self.steps = []
        for part in path.split():
            m = _STEP.match(part)
            if not m:
                raise ValueError(f"not a selector: {text}")
            marks = re.findall(r"([.#\[])([\w-]+)", m[2])
            self.steps.append(((m[1] or "*").lower(), marks))

    @staticmethod
    def _fits(step, tag: str, attributes: dict[str, str]) -> bool:
        name, marks = step
        if name not in ("*", tag):
            return False
        for kind, value in marks:
            if kind == "." and value not in attributes.get("class", "").split():
                return False
            if kind == "#" and attributes.get("id") != value or kind == "[" and value not in attributes:
                return False
        return True

    def matches(self, stack: list[tuple[str, dict[str, str]]]) -> bool:
        if not self._fits(self.steps[-1], *stack[-1]):
            return False
        left = len(self.steps) - 2
        for element in reversed(stack[:-1]):
            if left < 0:
                break
            left -= self._fits(self.steps[left], *element)
        return left < 0


class _Page(HTMLParser):
    """Collects what each selector picks, in one pass. Unclosed paragraphs end at the next one; stray end tags are ignored."""

    def __init__(self, selectors: list[_Selector]) -> None:
        super().__init__(convert_charrefs=True)
        self.selectors = selectors
        self.found: list[list[str]] = [[] for _ in selectors]
        self.stack: list[tuple[str, dict[str, str]]] = []
        self.open: list[tuple[int, int, list[str]]] = []  # depth, selector, pieces

    def _leave(self, depth: int) -> None:
        """Close the elements deeper than ``depth``."""
        del self.stack[depth:]
        while self.open and self.open[-1][0] > depth:
            _, k, pieces = self.open.pop()
            self.found[k][pieces[0]] = " ".join(" ".join(pieces[1:]).split())

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li"):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == tag:
                    self._leave(k)
                    break
                if self.stack[k][0] not in ("b", "i", "em", "strong", "a", "span", "p"):
                    break
        self.stack.append((tag, {a: v or "" for a, v in attrs}))
        for k, s in enumerate(self.selectors):
            if s.matches(self.stack):
                if s.attribute is not None:
                    self.found[k].append(self.stack[-1][1].get(s.attribute, "").strip())
                elif tag not in _VOID:
                    self.found[k].append("")
                    self.open.append((len(self.stack), k, [len(self.found[k]) - 1]))
        if tag in _VOID:
            self.stack.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._leave(k)
                break

    def handle_data(self, data):
        if self.open and not any(t in _HIDDEN for t, _ in self.stack):
            for _, _, pieces in self.open:
                pieces.append(data)

    def close(self):
        super().close()
        self._leave(0)


SELECTED = T.StructType(
    [T.StructField(x, T.StringType()) for x in ("title", "subtitle", "author", "published_at", "category", "body")]
    + [T.StructField(x, T.ArrayType(T.StringType())) for x in ("image_urls", "tags")]
)


def select_fields(page: str | None, selectors: Selectors) -> dict:
    """What the selectors find in a page; null and empty lists where they find nothing."""
    names = ("title", "subtitle", "author", "published_at", "category", "body", "images", "tags")
    tried = [(n, _Selector(s)) for n in names for s in getattr(selectors, n)]
    parser = _Page([s for _, s in tried])
    if page:
        parser.feed(page)
        parser.close()
    out: dict = dict.fromkeys(names)
    for (name, _), found in zip(tried, parser.found):
        kept = [x for x in found if x]
        if kept and out[name] is None:
            out[name] = kept if name in ("images", "tags") else "\n\n".join(kept) if name == "body" else kept[0]
    return {**{n: out[n] for n in names[:6]}, "image_urls": (out["images"] or [])[:10], "tags": out["tags"] or []}


def selected_udf(selectors: Selectors = Selectors()):
    """An Arrow function from a page to ``SELECTED``."""

    @F.pandas_udf(SELECTED)
    def select(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([select_fields(x, selectors) for x in s], columns=SELECTED.fieldNames(), dtype=object)

    return select
