"""Main body of web pages by minimum cut.

A page is cut into blocks, the runs of text that its markup sets off. A linear classifier over markup and text
features, fitted on a bounded sample, gives each block the cost of calling it content or boilerplate; these are the
terminal capacities of a graph. Blocks that follow each other, and blocks of one parent element, are joined by
smoothness edges, whose weights by kind are fitted with the scale of the terminal costs. The maximum flow separates content
from boilerplate. Blocks whose terminal cost outweighs all their edges keep their side in every minimum cut, so the flow is
computed for the rest only.

The sample needs no hand labels: a block counts as content if the extracted body of its page holds it as a line that is
not repeated over the source's records.
"""

from __future__ import annotations

import html
import math
import zlib
from collections import Counter, deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm.lines import frequent_lines, line_hashes, source_lines
from inkstream.session import materialize


@dataclass(frozen=True)
class CutFit:
    """sample_pages: most pages the classifier is fitted on. features: size of the hashed feature space. rounds: of the classifier's
    fit. folds: parts for the held-out costs that the edges are fitted with, once of pages and once of sources."""

    sample_pages: int = 1500
    features: int = 4096
    rounds: int = 150
    folds: int = 2


_TAG = regex.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|button|head)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)/?>|<[!?][^>]*+>",
    regex.I | regex.S,
)
_ATTRIBUTE = regex.compile(r"([a-z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", regex.I)
_WHITE = regex.compile(r"\s+")
_END = regex.compile(r"[.!?।…。][\"'”’»)\]]*$")
_SENTENCES = regex.compile(r"[.!?।。][\"'”’»)]*(?:\s|$)")
# Elements that set text off, those without content, and those that end an open paragraph.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote".split())


class Block:
    """A run of text: its tidy text, the path of elements it stands in, the element it belongs to, and its features."""

    __slots__ = ("features", "home", "links", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], home: int, links: float) -> None:
        self.text, self.path, self.home, self.links = text, path, home, links
        self.features: list[str] = []


def tidy(text: str) -> str:
    """Entities decoded, white space as single spaces, trimmed."""
    return " ".join(html.unescape(text).split())


def _label(tag: str, attributes: str) -> str:
    """tag, its classes and id, and the names of its other attributes, as one token."""
    if not attributes or attributes.isspace():
        return tag
    names: list[str] = []
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        names.append(f"{name}={value.lower()}" if name in ("class", "id", "role") else name)
    return f"{tag}[{' '.join(sorted(names))}]"


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order. Unclosed and stray tags are tolerated: a new paragraph or list item ends an open
    one, an end tag ends what is open inside its element, and is ignored if its element isn't open."""
    out: list[Block] = []
    stack: list[tuple[str, str, int]] = []  # tag, label, number
    number = 0
    piece: list[str] = []
    linked, in_link, breaks = 0, 0, 0
    where: tuple[tuple[str, ...], int] | None = None

    def place() -> tuple[tuple[str, ...], int]:
        home = 0
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in BLOCKS:
                home = stack[k - 1][2] if stack[k][0] in LEAVES and k else stack[k][2]
                break
        return tuple(x[1] for x in stack), home

    def flush() -> None:
        nonlocal piece, linked, where, breaks
        if where is not None:
            text = tidy("".join(piece))
            if text:
                out.append(Block(text, where[0], where[1], linked / len(text)))
        piece, linked, where, breaks = [], 0, None, 0

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            raw = page[at : m.start()]
            if not raw.isspace():
                if breaks > 1:
                    flush()
                breaks = 0
                where = where or place()
                linked += len(raw) if in_link else 0
            piece.append(raw)
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            breaks += 1
            continue
        if m[2]:
            if tag in BLOCKS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in ("td", "table") and tag not in ("td", "tr", "table", "tbody", "body", "html"):
                    break
            in_link = sum(x[0] == "a" for x in stack)
            continue
        if tag in BLOCKS:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] == tag and tag in ("li", "dd", "dt", "td", "tr", "th"):
                    del stack[k:]
                    break
                if stack[k][0] in ("td", "table", "ul", "ol", "div", "section", "article", "aside"):
                    break
            in_link = sum(x[0] == "a" for x in stack)
        if tag not in VOID:
            number += 1
            stack.append((tag, _label(tag, m[4]), number))
            in_link += tag == "a"
        elif tag == "hr":
            number += 1
    if at < len(page) and not page[at:].isspace():
        where = where or place()
        piece.append(page[at:])
    flush()
    _describe(out)
    return out


def _describe(found: list[Block]) -> None:
    head = next((i for i, b in enumerate(found) if any(x == "h1" or x.startswith("h1[") for x in b.path)), None)
    homes = Counter(b.home for b in found)
    mass: Counter = Counter()
    for b in found:
        mass[b.home] += len(b.text) * (b.links < 0.5)
    heaviest = max(mass, key=lambda h: (mass[h], -h)) if mass else None
    for i, b in enumerate(found):
        size = len(b.text)
        f = ["bias", f"size{min(int(math.log2(size + 1)), 10)}", f"links{int(b.links * 4)}", f"ends{bool(_END.search(b.text))}"]
        f.append(f"sentences{min(len(_SENTENCES.findall(b.text)), 4)}")
        f.append("head" if head is None else "before" if i < head else "is" if i == head else "first" if i == head + 1 else "after")
        f.append(f"home{min(homes[b.home], 4)}")
        f.append(f"heavy{b.home == heaviest}")
        if b.path:
            last = b.path[-1]
            f += [f"last:{last}", f"two:{' '.join(b.path[-2:])}"]
            f += {f"in:{x}" for x in b.path}
            f.append(f"last:{last.split('[')[0]} size{min(int(math.log2(size + 1)), 10)}")
        b.features = f


def _index(features: list[str], size: int, known: dict[str, int]) -> list[int]:
    out = []
    for x in features:
        k = known.get(x)
        if k is None:
            k = known[x] = zlib.crc32(x.encode("utf-8", "surrogatepass")) % size
        out.append(k)
    return out


@dataclass
class Classifier:
    """Weights of the hashed features, the scale that makes their sum a log-odds on unseen pages, and the weight of an edge by its kind."""

    weights: np.ndarray
    fit: CutFit
    scale: float = 1.0
    edges: dict[str, float] = field(default_factory=dict)

    def log_odds(self, found: list[Block], known: dict[str, int]) -> list[float]:
        w = self.weights
        if len(known) > 100_000:
            known.clear()
        return [self.scale * float(w[_index(b.features, len(w), known)].sum()) for b in found]

    def smoothness(self, found: list[Block]) -> list[tuple[int, int, float]]:
        return [(a, b, w) for a, b, kind in relations(found) if (w := self.edges.get(kind, 0.0)) > 0]


def _weights(rows: list[list[int]], y: np.ndarray, fit: CutFit) -> np.ndarray:
    """Logistic regression on rows of feature places."""
    w = np.zeros(fit.features)
    if not rows or y.all() or not y.any():
        return w
    flat = np.concatenate([np.array(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    grad2 = np.full(fit.features, 1e-8)
    for _ in range(fit.rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[flat], len(rows)), -30, 30)))
        g = np.bincount(flat, (p - y)[owner], fit.features) / len(rows) + 1e-5 * w
        grad2 += g * g
        w -= 0.5 * g / np.sqrt(grad2)
    return w


def _held_out(rows: list[list[int]], y: np.ndarray, groups: np.ndarray, fit: CutFit) -> np.ndarray:
    """The sum of weights of each row, by a fit on the rows of the other groups."""
    out = np.zeros(len(rows))
    for g in np.unique(groups):
        own = groups == g
        if own.all():
            continue
        w = _weights([r for r, o in zip(rows, own) if not o], y[~own], fit)
        for i in np.flatnonzero(own):
            out[i] = w[rows[i]].sum()
    return out


def _joint(odds: np.ndarray, around: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(scale, weight by kind of edge) that make the labels most likely, each given its own odds and its neighbours' labels
    (pseudo-likelihood). ``around``: by block and kind, neighbours that are content less those that are not. No weight is negative."""
    x = np.concatenate([odds[:, None], around], axis=1)
    free = np.ones(x.shape[1], bool)
    for _ in range(x.shape[1]):
        c = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
            g = (x[:, free].T @ (y - p)) - 1.0 * c[free]
            h = (x[:, free].T * (p * (1 - p))) @ x[:, free] + np.eye(free.sum())
            step = np.linalg.solve(h, g)
            c[free] += np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-6:
                break
        if (c >= 0).all():
            break
        free &= c >= 0
    return np.maximum(c, 0)


def fit_classifier(pages: list[tuple[str, str, str]], fit: CutFit) -> Classifier:
    """Terminal and smoothness costs from (source, page, extracted body without repeated lines) rows, as from ``sample_pages``.

    The scale of the terminal costs and the weights of the edges are fitted together on costs held out twice: by page, as for pages of
    the sampled sources, and by source, as for templates that were never seen.
    """
    rows: list[list[int]] = []
    y: list[bool] = []
    page_of: list[int] = []
    source_of: list[str] = []
    links: list[tuple[int, int, str]] = []
    known: dict[str, int] = {}
    for k, (source, page, body) in enumerate(pages):
        own = {" ".join(x.split()) for x in body.split("\n")}
        found = blocks(page)
        links += [(a + len(rows), b + len(rows), kind) for a, b, kind in relations(found)]
        for b in found:
            rows.append(_index(b.features, fit.features, known))
            y.append(b.text in own)
            page_of.append(k)
            source_of.append(source)
    labels = np.array(y, float)
    if not rows or not labels.any() or labels.all():
        return Classifier(np.zeros(fit.features), fit)
    kinds = sorted({kind for _, _, kind in links})
    around = np.zeros((len(rows), len(kinds)))
    for a, b, kind in links:
        around[a, kinds.index(kind)] += 2 * labels[b] - 1
        around[b, kinds.index(kind)] += 2 * labels[a] - 1
    names = {s: i for i, s in enumerate(sorted(set(source_of)))}
    groups = [np.array(page_of) % fit.folds, np.array([names[s] for s in source_of]) % fit.folds]
    held = [_held_out(rows, labels, g, fit) for g in groups]
    found_ = _joint(np.concatenate(held), np.concatenate([around] * 2), np.concatenate([labels] * 2))
    return Classifier(_weights(rows, labels, fit), fit, float(found_[0]), dict(zip(kinds, found_[1:].tolist())))


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it lies on the content side of a minimum cut.

    ``gain``: how much cheaper content is than boilerplate for the node (its terminal capacity, by sign); ``edges``:
    (a, b, weight), paid when a and b lie apart. Ties go to boilerplate.
    """
    n = len(gain)
    gain = list(gain)
    side: list[bool | None] = [None] * n
    around: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        around[a].append((b, w))
        around[b].append((a, w))
    slack = [sum(w for _, w in x) for x in around]
    todo = deque(range(n))
    while todo:  # nodes that no minimum cut can put elsewhere; their edges become terminal costs of the neighbours
        i = todo.popleft()
        if side[i] is not None or abs(gain[i]) <= slack[i]:
            continue
        side[i] = gain[i] > 0
        for j, w in around[i]:
            if side[j] is None:
                gain[j] += w if side[i] else -w
                slack[j] -= w
                todo.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        content = _source_side(rest, gain, around, side)
        for i in rest:
            side[i] = i in content
    return [bool(x) for x in side]


def _source_side(rest: list[int], gain: list[float], around: list[list[tuple[int, float]]], side: list[bool | None]) -> set[int]:
    """Nodes the source still reaches once the flow is at its maximum (blocking flows in level graphs)."""
    place = {i: k for k, i in enumerate(rest)}
    n = len(rest)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for k, i in enumerate(rest):
        if gain[i] > 0:
            arc(s, k, gain[i], 0.0)
        elif gain[i] < 0:
            arc(k, t, -gain[i], 0.0)
        for j, w in _merged(around[i]):
            if j > i and side[j] is None:
                arc(k, place[j], w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return {i for k, i in enumerate(rest) if level[k] >= 0}
        at = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                first = len(path)
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                    if cap[e] <= 1e-12 and first == len(path):
                        first = k
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while at[a] < len(out[a]):
                e = out[a][at[a]]
                if cap[e] > 1e-12 and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(out[a]):
                path.append(out[a][at[a]])
                a = to[path[-1]]
            elif path:
                level[a] = -1
                a = to[path.pop() ^ 1]
            else:
                break


def _merged(pairs: list[tuple[int, float]]) -> list[tuple[int, float]]:
    out: dict[int, float] = {}
    for j, w in pairs:
        out[j] = out.get(j, 0.0) + w
    return list(out.items())


def relations(found: list[Block]) -> list[tuple[int, int, str]]:
    """Edges between neighbours in the text, by how far apart they are in the tree, and between a block and the next one of its kind in
    its parent element: (a, b, kind)."""
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            same = a.home == b.home and a.path[-1:] == b.path[-1:]
            common = sum(x == y for x, y in zip(a.path, b.path))
            apart = max(len(a.path), len(b.path)) - common
            edges.append((i - 1, i, "same" if same else f"apart{min(apart, 3)}"))
        if b.home in last and last[b.home] < i - 1 and found[last[b.home]].path[-1:] == b.path[-1:]:
            edges.append((last[b.home], i, "sibling"))
        last[b.home] = i
    return edges


def content(page: str, classifier: Classifier, known: dict[str, int]) -> list[str]:
    """The paragraphs and subheadings of the page's own text."""
    found = blocks(page)
    if not found:
        return []
    side = min_cut(classifier.log_odds(found, known), classifier.smoothness(found))
    return [b.text for b, x in zip(found, side) if x]


def sample_pages(pages: DataFrame, extracted: DataFrame, fit: CutFit) -> list[tuple[str, str, str]]:
    """About ``sample_pages`` rows (source, page, body), chosen by a hash of the page id.

    The bodies come without the lines that their source repeats, counted over all records and not only the chosen ones.
    ``pages``: (page_id, source, page); ``extracted``: (page_id, body).
    """
    extracted = extracted.select("page_id", "body").where("body is not null")
    pages = pages.select("page_id", "source", "page").where("page is not null")
    total = extracted.count()
    pick = F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < (int(1_000_000 * fit.sample_pages / total) + 1 if total else 0)
    bodies = extracted.where(pick & F.col("body").rlike(r"\S")).dropDuplicates(["page_id"])
    rows = pages.where(pick).dropDuplicates(["page_id"]).join(bodies, "page_id").orderBy(F.xxhash64("page_id"), "page_id")
    rows = materialize(rows.select(F.col("page_id").alias("doc"), "source", "page", "body").limit(fit.sample_pages), "sample")
    docs = extracted.withColumnRenamed("page_id", "doc")
    origins = pages.select(F.col("page_id").alias("doc"), "source").dropDuplicates(["doc"])
    repeated = frequent_lines(source_lines(docs, origins), docs, origins, least_docs=3, least_share=0.02).select("source", "key")
    own = line_hashes(rows.select("doc", "body")).join(rows.select("doc", "source"), "doc")
    drop = own.join(repeated, ["source", "key"], "left_semi").groupBy("doc").agg(F.collect_set("line_no").alias("drop"))
    out = []
    for r in rows.join(drop, "doc", "left").orderBy(F.xxhash64("doc"), "doc").select("source", "page", "body", "drop").collect():
        gone = set(r["drop"] or [])
        out.append((r["source"], r["page"], "\n".join(x for i, x in enumerate(r["body"].split("\n"), 1) if i not in gone)))
    return out


def page_bodies(pages: DataFrame, classifier: Classifier) -> DataFrame:
    """(page_id, paragraphs): the main body of each page, in order. ``pages``: (page_id, page); a null page has none."""
    shared = pages.sparkSession.sparkContext.broadcast(classifier)  # one weight a feature
    key, page = pages.columns[:2]

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            found = [content(x, shared.value, known) if x else [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, pa.list_(pa.string()))], ["page_id", "paragraphs"])

    return pages.select(key, page).mapInArrow(run, "page_id long, paragraphs array<string>")
