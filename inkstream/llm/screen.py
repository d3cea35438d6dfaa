"""Abusive, hateful and sexual content by compression distance.

One zstandard dictionary is trained on ordinary text and one on the passages of each category. A window (a sentence)
is compressed with each; the share by which a category's dictionary makes it shorter than the ordinary one is its
score, and a document's score is that of its best window. Labels are given to whole documents; ``passages`` finds the
sentences that are meant. Thresholds are calibrated on documents whose windows were not in the dictionaries. A category
with too few passages to train a dictionary on scores 0 everywhere and is never found.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm.text import WORDS, usual_form

CATEGORIES = ("abusive", "hateful", "sexual")


@dataclass(frozen=True)
class ScreenFit:
    """label_rows: most labelled documents that are used. ordinary_bytes: most ordinary text that is trained on.
    dictionary_bytes: largest dictionary. bytes_per_byte: sampled bytes for each byte of a dictionary. segment, gram: sizes of
    the pieces the trainer picks and of the runs it counts. least_window: shorter sentences join the next one of their
    paragraph. level: zstandard level. pooled, flat: see ``_cuts``. purity: least mean share of positive documents among
    those that hold the words and word pairs of a passage trained on."""

    label_rows: int = 8000
    ordinary_bytes: int = 2_000_000
    dictionary_bytes: int = 65_536
    bytes_per_byte: int = 2
    segment: int = 64
    gram: int = 6
    least_window: int = 24
    level: int = 3
    pooled: float = 10.0
    flat: float = 0.02
    purity: float = 0.5
    seed: int = 7


_SENTENCE = re.compile(r"(?<=[.!?।…])[\"”»')\]]*\s+|\n+")
_NOISE = re.compile("[©®°™\u2190-\u23ff\u2460-\u27bf\u2900-\u2bff\ufe0f\U0001f000-\U0001fbff]+")
_DIGITS = re.compile(r"\d+")
_SPACED = re.compile(r"\b(?:[a-zß-ɏ] ){3,}[a-zß-ɏ]\b")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_MARKED = re.compile(r"(?<=[a-zß-ɏ])[.*_\-'|]+(?=[a-zß-ɏ])")


def windows(text: str, least: int) -> list[str]:
    """The sentences of ``text``, normalised: usual form, lower case, digits as 0, no emoji; letters set apart
    ("i d i o t"), drawn out ("idiooot") or parted by signs ("id.iot") are put together."""
    text = _DIGITS.sub("0", _NOISE.sub(" ", usual_form(text).lower()))
    text = _MARKED.sub("", _LONG.sub(r"\1", _SPACED.sub(lambda m: m[0].replace(" ", ""), text)))
    out: list[str] = []
    for paragraph in text.split("\n"):
        held = ""
        for s in _SENTENCE.split(paragraph):
            held = f"{held} {s}".strip()
            if len(held) >= least:
                out.append(held)
                held = ""
        if held:
            out.append(held)
    return out


def _dictionary(samples: list[bytes], fit: ScreenFit) -> bytes | None:
    """A dictionary trained on all samples; None where the trainer finds them too few."""
    size = max(256, min(fit.dictionary_bytes, sum(map(len, samples)) // fit.bytes_per_byte))
    try:
        return zstandard.train_dictionary(size, samples, k=fit.segment, d=fit.gram).as_bytes()
    except zstandard.ZstdError:
        return None


@dataclass
class Screen:
    """Dictionaries and thresholds; plain data, so that it can be sent to workers."""

    ordinary: bytes | None
    toxic: dict[str, bytes | None]
    threshold: dict[str, float] = field(default_factory=dict)
    level: int = 3

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _compressor(self, raw: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=self.level)
        return zstandard.ZstdCompressor(level=self.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

    def _compressors(self) -> tuple:
        if not hasattr(self, "_c"):
            own = [(k, self._compressor(self.toxic[c])) for k, c in enumerate(CATEGORIES) if self.ordinary and self.toxic[c]]
            self._c = (self._compressor(self.ordinary) if own else None, own)
        return self._c

    def score_window(self, window: bytes) -> list[float]:
        """By category, the share saved against the ordinary dictionary; a category that another one beats gets at
        most what is left after the difference. Categories without a dictionary get 0."""
        ordinary, toxic = self._compressors()
        out = [0.0] * len(CATEGORIES)
        if not toxic:
            return out
        plain = len(ordinary.compress(window))
        own = [(k, len(c.compress(window))) for k, c in toxic]
        best = min(x for _, x in own)
        for k, x in own:
            out[k] = (plain - x - 2 * (x - best)) / max(plain, 24)
        return out

    def score(self, texts: list[bytes]) -> list[float]:
        """By category, the score of the best window; 0 for a text without windows."""
        out = [0.0] * len(CATEGORIES)
        for w in texts:
            for k, s in enumerate(self.score_window(w)):
                if s > out[k]:
                    out[k] = s
        return out


Labelled = tuple[list[bytes], tuple[int, ...]]


def _train(docs: list[Labelled], chosen: list[list[list[bytes]]], fit: ScreenFit) -> Screen:
    """Dictionaries from the windows ``chosen`` by document and category, and from documents of no category."""
    plain = [w for ws, labels in docs if not any(labels) for w in ws]
    random.Random(fit.seed).shuffle(plain)
    total, ordinary = 0, []
    for w in plain:
        total += len(w)
        if total > fit.ordinary_bytes:
            break
        ordinary.append(w)
    toxic = {c: _dictionary([w for own in chosen for w in own[k]], fit) for k, c in enumerate(CATEGORIES)}
    return Screen(_dictionary(ordinary, fit), toxic, level=fit.level)


def _cuts(scores: np.ndarray, labels: np.ndarray, fit: ScreenFit) -> list[float]:
    """A threshold by category (column): the middle of the widest range with about the fewest errors.

    The errors of all categories together count as ``pooled`` more positive documents of each, so a category with few labels
    leans on the others and one with many does not. Labels have mistakes, so the fewest errors are a flat range (within
    ``flat`` of the positive documents), and its widest part is where the two kinds come apart.
    """
    levels = np.unique(np.concatenate([[0.0], scores[scores > 0].ravel(), [1.0]]))
    errors = np.empty((scores.shape[1], len(levels) - 1))
    for k in range(scores.shape[1]):
        hit = labels[:, k] > 0
        missed = np.searchsorted(np.sort(scores[hit, k]), levels[1:], side="left")  # scores below the level
        wrong = (~hit).sum() - np.searchsorted(np.sort(scores[~hit, k]), levels[1:], side="left")
        errors[k] = missed + wrong
    positive = labels.sum(axis=0)
    together = errors.sum(axis=0) * (fit.pooled / max(positive.sum(), 1))
    out = []
    for k in range(len(errors)):
        own = errors[k] + together
        good = own <= own.min() + fit.flat * (positive[k] + fit.pooled)
        best, start = (0.0, 1.0), None
        for i in range(len(good) + 1):
            if i < len(good) and good[i]:
                start = i if start is None else start
            elif start is not None:
                low, high = levels[start], levels[i]
                best, start = max(best, (high - low, (low + high) / 2)), None
        out.append(float(best[1]))
    return out


def passages(docs: list[Labelled], fit: ScreenFit) -> list[list[list[bytes]]]:
    """By document and category, the windows of a positive document that are meant by its label: those whose words and
    word pairs stand mostly in documents of the category. Ordinary sentences of the same documents stand everywhere."""
    seen: Counter = Counter()
    positive: list[Counter] = [Counter() for _ in CATEGORIES]
    for ws, y in docs:
        own = set().union(*map(_features, ws))
        seen.update(own)
        for k in range(len(CATEGORIES)):
            if y[k]:
                positive[k].update(own)
    out = []
    for ws, y in docs:
        chosen: list[list[bytes]] = [[] for _ in CATEGORIES]
        for w in ws if any(y) else ():
            known = [x for x in _features(w) if seen[x] > 2]
            for k in range(len(CATEGORIES)):
                if y[k] and known and sum(positive[k][x] / seen[x] for x in known) / len(known) >= fit.purity:
                    chosen[k].append(w)
        out.append(chosen)
    return out


def _features(window: bytes) -> set[str]:
    words = WORDS.findall(window.decode("utf-8", "surrogatepass"))
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def fit_screen(labelled: list[tuple[str, tuple[int, ...]]], fit: ScreenFit) -> Screen:
    """Dictionaries and thresholds from (text, labels by category) rows. Thresholds are calibrated across: each half of
    the documents is scored with the dictionaries of the other half."""
    docs: list[Labelled] = [([w.encode("utf-8", "surrogatepass") for w in windows(t, fit.least_window)], y) for t, y in labelled]
    chosen = passages(docs, fit)
    halves = [_train(docs[h::2], passages(docs[h::2], fit), fit) for h in (0, 1)]
    scores = [halves[1 - i % 2].score(ws) for i, (ws, _) in enumerate(docs)]
    screen = _train(docs, chosen, fit)
    size = (len(docs), len(CATEGORIES))
    cuts = _cuts(np.array(scores).reshape(size), np.array([y for _, y in docs]).reshape(size), fit)
    screen.threshold = dict(zip(CATEGORIES, cuts))
    return screen


def labelled_texts(docs: DataFrame, labels: DataFrame, fit: ScreenFit) -> list[tuple[str, tuple[int, ...]]]:
    """At most ``label_rows`` rows (text, labels), chosen by a hash of the document. Several labels of a document are
    settled by majority; null labels count as 0, labels without document and documents without text are left out."""
    votes = labels.where("doc_id is not null").groupBy("doc_id")
    settled = votes.agg(*[(F.avg(F.coalesce(F.col(c), F.lit(0))) > 0.5).cast("int").alias(c) for c in CATEGORIES])
    settled = settled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit.label_rows)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(settled), "doc_id")  # at most label_rows
    ordered = rows.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", *CATEGORIES)
    return [(r["text"], tuple(r[c] for c in CATEGORIES)) for r in ordered.collect()]


def score_documents(docs: DataFrame, screen: Screen, fit: ScreenFit) -> DataFrame:
    """(id, one score by category) of ``docs`` (id, text); null and empty texts score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(screen)  # four dictionaries of dictionary_bytes
    key, text = docs.columns[:2]

    def run(batches):
        own = shared.value
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                ws = windows(t, fit.least_window) if t else []
                out.append(own.score([w.encode("utf-8", "surrogatepass") for w in ws]))
            columns = [pa.array([s[k] for s in out], pa.float64()) for k in range(len(CATEGORIES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *CATEGORIES])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} double" for c in CATEGORIES))


def categories(scores: DataFrame, screen: Screen) -> DataFrame:
    """(id, category, score) of each category a document falls in."""
    each = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("score"), F.lit(screen.threshold[c]).alias("cut")) for c in CATEGORIES])
    rows = scores.select("id", F.explode(each).alias("x")).where("x.score >= x.cut and x.score > 0")
    return rows.select("id", "x.category", "x.score")


def rates(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(source, documents, one rate by category) from (id, category) rows and ``docs`` (id, source)."""
    hits = found.groupBy("id").pivot("category", list(CATEGORIES)).agg(F.lit(1))
    joined = docs.select(F.col(docs.columns[0]).alias("id"), F.col(docs.columns[1]).alias("source")).join(hits, "id", "left")
    share = [F.round(F.sum(F.coalesce(F.col(c), F.lit(0))) / F.count("*"), 6).alias(f"{c}_rate") for c in CATEGORIES]
    return joined.groupBy("source").agg(F.count("*").alias("documents"), *share)


