"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

A model of order 5 per language is fitted on a bounded sample of labelled texts. Labels may be noisy: models of each half
of the sample are held against the other half; a label whose texts the more frequent languages explain as well as its own
model is no language of its own, and paragraphs that another language fits better are left out. All n-grams of all
languages stand in one sorted array of 64-bit hashes with a matrix of log-probabilities beside it, so one look-up serves
every language. A text gets the language with the lowest cross-entropy per character. It is rejected (null) when that
cross-entropy lies above a level set on held-out texts that are scored with and without the model of their language, or when
the calibrated confidence is too low.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstream.llm.text import mix, usual_form

# Names and three-letter codes of languages with the two-letter code they stand for.
LANGUAGE_NAMES = {
    "ben": "bn", "bengali": "bn", "bangla": "bn", "বাংলা": "bn", "eng": "en", "english": "en", "fra": "fr", "fre": "fr",
    "french": "fr", "français": "fr", "francais": "fr", "deu": "de", "ger": "de", "german": "de", "deutsch": "de",
    "spa": "es", "spanish": "es", "español": "es", "espanol": "es", "castellano": "es", "hin": "hi", "hindi": "hi",
    "nld": "nl", "dut": "nl", "dutch": "nl", "nederlands": "nl", "asm": "as", "assamese": "as", "ita": "it",
    "italian": "it", "por": "pt", "portuguese": "pt", "rus": "ru", "russian": "ru", "ara": "ar", "arabic": "ar",
    "urd": "ur", "urdu": "ur",
}
NO_LANGUAGE = ("", "und", "unknown", "none", "null", "n/a", "mul", "zxx", "mis")


def language_code(label: Column) -> Column:
    """The two-letter code a label names; null for labels that name none. Regional forms name their language."""
    text = F.lower(F.trim(F.regexp_replace(label, r"[\s ]+", " ")))
    head = F.regexp_extract(text, r"^([^-_ ]+)", 1)
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    code = F.coalesce(F.try_element_at(names, text), F.try_element_at(names, head), F.when(F.length(head) == 2, head))
    return F.when(text.isin(*NO_LANGUAGE), None).otherwise(code)


_WORD = regex.compile(r"[\p{L}\p{M}‌‍]+")
_PARAGRAPH = regex.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")


def paragraphs(body: str) -> list[str]:
    """The body's paragraphs: parts between blank lines that hold more than white space."""
    return [p for p in _PARAGRAPH.split(body.replace("\r\n", "\n")) if p.strip()]


@dataclass(frozen=True)
class Fit:
    """order: longest n-gram. sample_rows: about how many labelled texts the models are fitted on. sample_chars: most
    characters of them. most_labels: how many labels, the most frequent, may get a model. least_texts: paragraphs a language
    needs in each half of the sample. margin: by how many nats a character a label's own model must be better on a paragraph
    than the other languages' for the paragraph to speak for the label. piece_words: lengths of the pieces that the
    confidence is calibrated on. foreign_accepted: share of texts of a language without a model that may pass for another one
    (held out: texts scored without their own model). least_confidence: a paragraph below it gets no language. least_coverage: share of the
    held-out sample that the models must accept."""

    order: int = 5
    sample_rows: int = 3000
    sample_chars: int = 12_000_000
    most_labels: int = 64
    least_texts: int = 3
    margin: float = 0.15
    piece_words: tuple[int, ...] = (1, 2, 4, 8, 16)
    foreign_accepted: float = 0.2
    least_confidence: float = 0.9
    least_coverage: float = 0.5


_START, _END = "\x02", "\x03"
_ALPHABET = 4096  # characters the uniform floor is spread over


def _hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all n-grams of ``length`` codes that end at each place (garbage before place length - 1)."""
    out = np.full(len(codes), np.uint64(length * 0x9E3779B97F4A7C15 % 2**64))
    for k in range(length - 1, -1, -1):
        out = mix(out ^ np.roll(codes, k))
    return out


def _spell(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words with start and end marks laid end to end, the word of each place, its place in it."""
    text = "".join(f"{_START}{w}{_END}" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return codes, owner, place


class LanguageModels:
    """Kneser-Ney models of several languages over one n-gram table."""

    def __init__(self, counts: dict[str, Counter], order: int) -> None:
        self.languages = sorted(counts)
        self.order = order
        per = [self._estimate(counts[x]) for x in self.languages]
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []  # by n-gram length: sorted hashes, log-probabilities
        self.backoff: list[tuple[np.ndarray, np.ndarray]] = []  # by context length: sorted hashes, log-weights
        size = len(self.languages)
        for n in range(order):
            keys = np.unique(np.concatenate([b[n][0] for _, b in per]))
            values = np.zeros((len(keys), size), np.float32)
            for k, (_, b) in enumerate(per):
                values[np.searchsorted(keys, b[n][0]), k] = b[n][1]
            self.backoff.append((keys, values))
        grams: dict[int, np.ndarray] = {}
        own = [self._grams(counts[x]) for x in self.languages]
        for n in range(1, order + 1):
            keys, first = np.unique(np.concatenate([g[n][0] for g in own]), return_index=True)
            context, suffix = (np.concatenate([g[n][k] for g in own])[first] for k in (1, 2))
            values = np.empty((len(keys), size), np.float32)
            lower = self._lookup(self.tables[n - 2], suffix)[0] if n > 1 else np.full((len(keys), size), -math.log(_ALPHABET), np.float32)
            gamma = self._lookup(self.backoff[n - 1], context)[0]
            for k, (p, _) in enumerate(per):
                at = np.minimum(np.searchsorted(p[n][0], keys), max(len(p[n][0]) - 1, 0))
                seen = p[n][0][at] == keys if len(p[n][0]) else np.zeros(len(keys), bool)
                higher = np.where(seen, p[n][1][at] if len(p[n][0]) else 0, 0)
                values[:, k] = np.log(higher + np.exp(gamma[:, k] + lower[:, k]))
            self.tables.append((keys, values))
            grams[n] = keys
        self.limit = math.inf  # cross-entropy above which a text is rejected
        self.scale = 1.0  # of the log-probabilities, before they become a confidence
        self.coverage = 1.0  # share of the held-out sample that is not rejected
        self.reliability: list[tuple[float, int, float, float]] = []  # least confidence of a bin, pieces, mean confidence, share right

    def _grams(self, counts: Counter) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By length: distinct n-gram hashes with the hashes of their context and suffix, and their counts."""
        words = list(counts)
        weight = np.fromiter(counts.values(), np.int64, len(counts))
        codes, owner, place = _spell(words)
        out = {}
        for n in range(1, self.order + 1):
            ok = (place >= n - 1) & ((place > 0) if n == 1 else True)
            h = _hashes(codes, n)[ok]
            context = np.roll(_hashes(codes, n - 1), 1)[ok] if n > 1 else np.zeros(ok.sum(), np.uint64)
            suffix = _hashes(codes, n - 1)[ok] if n > 1 else np.zeros(ok.sum(), np.uint64)
            keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            total = np.bincount(inverse, weight[owner[ok]], len(keys))
            out[n] = keys, context[first], suffix[first], total
        return out

    def _estimate(self, counts: Counter) -> tuple[dict, list]:
        """Discounted probabilities by n-gram length, and interpolation weights by context length."""
        grams = self._grams(counts)
        p, backoff = {}, []
        for n in range(1, self.order + 1):
            keys, context, _, total = grams[n]
            if n < self.order:  # continuation counts: in how many longer n-grams it is the suffix
                longer = grams[n + 1][2]
                number = np.bincount(np.searchsorted(keys, longer), minlength=len(keys)).astype(float)
                begins = number == 0  # n-grams that begin a word have nothing before them
                number = np.where(begins, np.minimum(total, 1), number)
            else:
                number = total
            one, two = (number == 1).sum(), (number == 2).sum()
            discount = float(np.clip(one / max(one + 2 * two, 1), 0.1, 0.9))
            contexts, inverse = np.unique(context, return_inverse=True)
            mass = np.bincount(inverse, number, len(contexts))
            kinds = np.bincount(inverse, minlength=len(contexts))
            p[n] = keys, (number - discount).clip(0) / mass[inverse]
            backoff.append((contexts, np.log(discount * kinds / mass).astype(np.float32)))
        return p, backoff

    @staticmethod
    def _lookup(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        if not len(keys):
            return np.zeros((len(h), values.shape[1]), np.float32), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        seen = keys[at] == h
        return np.where(seen[:, None], values[at], np.float32(0)), seen

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word (with its end mark) in each language."""
        out = np.zeros((len(words), len(self.languages)))
        if not words:
            return out
        codes, owner, place = _spell(words)
        logp = np.zeros((len(codes), len(self.languages)), np.float32)
        open_ = place > 0
        for n in range(self.order, 0, -1):
            todo = np.flatnonzero(open_ & (place >= n - 1))
            if not len(todo):
                continue
            values, seen = self._lookup(self.tables[n - 1], _hashes(codes, n)[todo])
            logp[todo[seen]] += values[seen]
            rest = todo[~seen]
            context = np.roll(_hashes(codes, n - 1), 1)[rest] if n > 1 else np.zeros(len(rest), np.uint64)
            logp[rest] += self._lookup(self.backoff[n - 1], context)[0]
            open_[todo[seen]] = False
        logp[open_] -= math.log(_ALPHABET)
        np.add.at(out, owner, logp)
        return out


class Identifier:
    """Scores texts, remembering the words it has scored up to a bound."""

    def __init__(self, models: LanguageModels, most: int = 200_000) -> None:
        self.models, self.most = models, most
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.models.languages)))
        self.sizes = np.zeros(0)

    def score(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(log-probabilities by text and language, characters by text) of texts given as words."""
        if len(self.known) > self.most:
            self._reset()
        known = self.known
        new = list(dict.fromkeys(w for t in texts for w in t if w not in known))
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.scores = np.concatenate([self.scores, self.models.score_words(new)])
            self.sizes = np.concatenate([self.sizes, np.fromiter((len(w) + 1 for w in new), float, len(new))])
        at = np.fromiter((known[w] for t in texts for w in t), np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        logp = np.stack([np.bincount(owner, self.scores[at, k], len(texts)) for k in range(len(self.models.languages))], axis=1)
        return logp, np.bincount(owner, self.sizes[at], len(texts))

    def classify(self, texts: list[list[str]], fit: Fit) -> list[tuple[str | None, float, int]]:
        """(language or None, confidence, letters) of each text."""
        logp, sizes = self.score(texts)
        best = logp.argmax(axis=1)
        entropy = -logp[np.arange(len(texts)), best] / np.maximum(sizes, 1)
        z = (logp - logp.max(axis=1, keepdims=True)) * self.models.scale
        confidence = 1 / np.exp(z).sum(axis=1)
        names = self.models.languages
        return [
            (None, 0.0, int(s)) if not s or c < fit.least_confidence or e > self.models.limit else (names[b], float(c), int(s))
            for b, e, c, s in zip(best.tolist(), entropy.tolist(), confidence.tolist(), sizes.tolist())
        ]


def _counts(texts: Iterable[list[str]]) -> Counter:
    return Counter(w for t in texts for w in t)


@dataclass(frozen=True)
class Paragraph:
    """A labelled paragraph of the sample: its words, the rows of the table it stands for, the half of the sample it is in."""

    label: str
    words: list[str]
    weight: float
    half: int


def _half_models(rows: list[Paragraph], half: int, fit: Fit) -> Iterator[LanguageModels]:
    """Models of the labels with enough paragraphs in a half, few labels at a time so that the tables stay small."""
    groups: dict[str, list[list[str]]] = {}
    for r in rows:
        if r.half == half:
            groups.setdefault(r.label, []).append(r.words)
    names = sorted(k for k, v in groups.items() if len(v) >= fit.least_texts)
    for at in range(0, len(names), 16):
        yield LanguageModels({k: _counts(groups[k]) for k in names[at : at + 16]}, fit.order)


def _held_out(rows: list[Paragraph], fit: Fit) -> tuple[list[str], np.ndarray]:
    """Labels, and the cross-entropy per character of each paragraph under each label's model of the other half
    (infinite where that half has too few paragraphs of the label)."""
    names = sorted({r.label for r in rows})
    place = {x: k for k, x in enumerate(names)}
    out = np.full((len(rows), len(names)), np.inf)
    for half in (0, 1):
        other = [i for i, r in enumerate(rows) if r.half != half]
        for models in _half_models(rows, half, fit) if other else ():
            logp, sizes = Identifier(models).score([rows[i].words for i in other])
            out[np.ix_(other, [place[x] for x in models.languages])] = -logp / sizes[:, None]
    return names, out


def _languages(rows: list[Paragraph], names: list[str], entropy: np.ndarray, fit: Fit) -> list[int]:
    """Columns of the labels that name a language of their own.

    From the most frequent label down: a label is left out when the languages taken so far explain most of its paragraphs
    about as well as its own model. So labels set by mistake, whose texts are those of other languages, never push a more
    frequent label out, however many they are.
    """
    weight: Counter = Counter()
    for r in rows:
        weight[r.label] += r.weight
    labels = np.array([names.index(r.label) for r in rows])
    weights = np.array([r.weight for r in rows])
    taken: list[int] = []
    for x in sorted(range(len(names)), key=lambda k: (-weight[names[k]], names[k])):
        own = (labels == x) & np.isfinite(entropy[:, x])
        if not own.any():
            continue
        if taken:
            explained = entropy[np.ix_(own, taken)].min(axis=1) <= entropy[own, x] + fit.margin
            if (weights[own] * explained).sum() * 2 >= weights[own].sum():
                continue
        taken.append(x)
    return taken


def _cut(inside: np.ndarray, outside: np.ndarray, fit: Fit) -> float:
    """The rejection level from held-out cross-entropies under the right model, and under the best other one.

    Texts of another kind than the sample's have higher cross-entropies than the sample's own, so the level is as high as
    the share ``foreign_accepted`` allows, and never so low that one of 1,000 texts of the languages is rejected."""
    least = float(np.quantile(inside, 0.999))
    return max(least, float(np.quantile(outside, fit.foreign_accepted))) if len(outside) else least * 1.5


def fit_models(sample: list[tuple[str, str, float]], fit: Fit) -> LanguageModels | None:
    """Models from (label code, text, weight) rows with noisy labels; each paragraph counts as a text with its text's label.

    Rejection and confidence are calibrated on held-out paragraphs. None if no language has enough texts; nothing can be
    identified then. ValueError if the models accept less than ``least_coverage`` of the held-out sample.
    """
    rows = [
        Paragraph(label, own, weight, k % 2)
        for k, (label, text, weight) in enumerate(sample)
        if label and text
        for p in paragraphs(usual_form(text).lower())
        if (own := _WORD.findall(p))
    ]
    if not rows:
        return None
    names, entropy = _held_out(rows, fit)
    taken = _languages(rows, names, entropy, fit)
    if not taken:
        return None
    best = entropy[:, taken].argmin(axis=1)
    clean = [r for r, b in zip(rows, best) if r.label == names[taken[b]]]
    groups: dict[str, list[list[str]]] = {}
    for r in clean:
        groups.setdefault(r.label, []).append(r.words)
    models = LanguageModels({k: _counts(v) for k, v in groups.items()}, fit.order)
    _calibrate(models, clean, rows, fit)
    return models


def _calibrate(models: LanguageModels, clean: list[Paragraph], rows: list[Paragraph], fit: Fit) -> None:
    """Set the rejection level, the scale of the confidence and its reliability from held-out paragraphs.

    Rejection: cross-entropies under the right model against those under the best other one, which is how a language without
    a model would look. Confidence: pieces of a few words cut from the paragraphs, whose language is known from the whole.
    """
    names = models.languages
    inside, outside, scores, truth, rest = [], [], [], [], []
    for half in (0, 1):
        groups = {x: _counts(r.words for r in clean if r.half == half and r.label == x) for x in names}
        other = [r for r in clean if r.half != half]
        if not other or not all(groups.values()):
            continue
        own = Identifier(LanguageModels(groups, fit.order))
        logp, sizes = own.score([r.words for r in other])
        right = np.array([names.index(r.label) for r in other])
        entropy = -logp / sizes[:, None]
        inside.append(entropy[np.arange(len(other)), right])
        entropy[np.arange(len(other)), right] = np.inf
        outside.append(entropy.min(axis=1))
        pieces = [
            (r.words[s : s + n], names.index(r.label))
            for k, r in enumerate(other)
            for n in fit.piece_words
            if n <= len(r.words)
            for s in (k * 7919 % (len(r.words) - n + 1),)
        ]
        if pieces:
            scores.append(own.score([w for w, _ in pieces])[0])
            truth += [x for _, x in pieces]
        every = [r for r in rows if r.half != half]
        logp, sizes = own.score([r.words for r in every])
        rest += [(float(e), r.weight) for e, r in zip((-logp / sizes[:, None]).min(axis=1), every)]
    if not inside:
        return
    far = np.concatenate(outside)
    models.limit = _cut(np.concatenate(inside), far[np.isfinite(far)], fit)
    models.coverage = sum(w for e, w in rest if e <= models.limit) / sum(w for _, w in rest)
    if models.coverage < fit.least_coverage:
        raise ValueError(f"the models of {names} accept {models.coverage:.2f} of the held-out sample")
    if scores and len(names) > 1:
        z, t = np.concatenate(scores), np.array(truth)
        z = z - z.max(axis=1, keepdims=True)
        at = np.arange(len(t))
        scales = np.geomspace(0.05, 2, 38)
        loss = [np.mean(np.log(np.exp(z * s).sum(axis=1)) - s * z[at, t]) for s in scales]
        models.scale = float(scales[int(np.argmin(loss))])
        sure = 1 / np.exp(z * models.scale).sum(axis=1)
        hit = z.argmax(axis=1) == t
        edges = np.array([0, 0.5, 0.7, 0.9, 0.99, 1.01])
        for low, high in zip(edges, edges[1:]):
            own_bin = (sure >= low) & (sure < high)
            if own_bin.any():
                models.reliability.append((float(low), int(own_bin.sum()), float(sure[own_bin].mean()), float(hit[own_bin].mean())))


def labelled_sample(docs: DataFrame, fit: Fit) -> list[tuple[str, str, float]]:
    """About ``sample_rows`` rows (code, text, weight) of ``docs`` (id, label, text), chosen by a hash of the id.

    Half are taken in proportion, half the same number for each of the ``most_labels`` most frequent labels as far as it has
    them, so that rare languages get a model too. weight: rows of the table with the label, for each one chosen.
    """
    key, label, text = docs.columns[:3]
    rows = docs.select(F.xxhash64(key).alias("h"), language_code(F.col(label)).alias("code"), F.col(text).alias("text"))
    rows = rows.where("code is not null and text is not null")
    counts = rows.groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(fit.most_labels)
    sizes = {r["code"]: r["n"] for r in counts.collect()}
    if not sizes:
        return []
    each, total = fit.sample_rows / 2 / len(sizes), sum(sizes.values())
    odds = {c: min(1.0, each / n + fit.sample_rows / 2 / total) for c, n in sizes.items()}
    share = F.create_map(*[F.lit(x) for c, o in odds.items() for x in (c, int(1_000_000 * o) + 1)])
    picked = rows.where(F.pmod(F.col("h"), F.lit(1_000_000)) < F.try_element_at(share, F.col("code")))
    picked = picked.orderBy("h", "text").limit(fit.sample_rows)
    out: list[tuple[str, str]] = []
    chars = 0
    for r in picked.select("code", "text").toLocalIterator():
        chars += len(r["text"])
        if chars > fit.sample_chars:
            break
        out.append((r["code"], r["text"]))
    chosen = Counter(c for c, _ in out)
    return [(c, t, sizes[c] / chosen[c]) for c, t in out]


PARTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("para_no", T.IntegerType()),
            T.StructField("lang", T.StringType()),
            T.StructField("confidence", T.DoubleType()),
            T.StructField("letters", T.IntegerType()),
        ]
    )
)
RESULT = T.StructType(
    [T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("segments", PARTS)]
)


def majority(parts: list[tuple[str | None, float, int]]) -> tuple[str | None, float]:
    """The language of most letters, with the letter-weighted confidence of its paragraphs."""
    weight: dict[str, float] = {}
    sure: dict[str, float] = {}
    for lang, confidence, letters in parts:
        if lang:
            weight[lang] = weight.get(lang, 0) + letters
            sure[lang] = sure.get(lang, 0) + letters * confidence
    if not weight:
        return None, 0.0
    top = max(weight, key=lambda x: (weight[x], x))
    return top, sure[top] / weight[top]


def identify(docs: DataFrame, models: LanguageModels | None, fit: Fit) -> DataFrame:
    """``docs`` (id, text) to (id, lang, confidence, segments): the language of most of the text, and the paragraphs in
    another language. Null or too short texts get null and no segments."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # fitted on at most sample_chars of text
    key, text = docs.columns[:2]

    def run(batches):
        identifier = Identifier(shared.value) if shared.value else None
        segment = pa.struct([("para_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("letters", pa.int32())])
        for batch in batches:
            parts: list[list[str]] = []
            ends = [0]
            for body in batch.column(1).to_pylist():
                if body:
                    parts += [_WORD.findall(p) for p in paragraphs(usual_form(body).lower())]
                ends.append(len(parts))
            found = identifier.classify(parts, fit) if identifier and parts else [(None, 0.0, 0)] * len(parts)
            langs, sure, segments = [], [], []
            for a, b in zip(ends, ends[1:]):
                top, confidence = majority(found[a:b])
                langs.append(top)
                sure.append(confidence)
                segments.append(
                    [{"para_no": k, "lang": x, "confidence": c, "letters": n} for k, (x, c, n) in enumerate(found[a:b], 1) if x and x != top]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(sure), pa.array(segments, pa.list_(segment))],
                ["id", "lang", "confidence", "segments"],
            )

    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), *RESULT.fields])
    return docs.select(key, text).mapInArrow(run, schema)
