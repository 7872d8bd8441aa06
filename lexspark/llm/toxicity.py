"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a logistic score over its words
and word beginnings; the document's probability is their noisy-or, one minus the
product of the sentences' complements. Only document labels are needed to train, and
the sentence scores then say where the offence lies.

Defined results: null, empty and wordless texts score 0; letters count alike in either
case, whatever else the text holds; very long texts are read whole; equal texts score equally; an empty table
gives an empty result; a model fitted without labels of both kinds scores 0. Other
columns are kept, and one named like a result is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import hashed_share, with_struct

SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?\n]+|$)")
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = range(4, 9)
CACHE = 100_000
#: Buckets in which features are counted first.
BUCKETS = 1 << 22
FIELDS = ["score", "predicted", "offending"]


@dataclass
class ToxicityModel:
    bias: float = -20.0
    weights: dict[str, float] = field(default_factory=dict)
    #: Score from which a document is called toxic, and a sentence offending.
    threshold: float = 0.7
    sentence_threshold: float = 0.3

    def __post_init__(self):
        self._cache: dict[str, float] = {}

    def word(self, w: str) -> float:
        s = self._cache.get(w)
        if s is None:
            s = sum(self.weights.get(f, 0.0) for f in features(w))
            if len(self._cache) >= CACHE:
                self._cache.clear()
            self._cache[w] = s
        return s


def features(word: str) -> list[str]:
    """The word itself, and its beginnings (marked by a trailing dash)."""
    return [word, *(f"{word[:k]}-" for k in PREFIXES if len(word) >= k)]


def spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in SENTENCE.finditer(text) if m.end() > m.start() and not m[0].isspace()]


def sentence_scores(model: ToxicityModel, text: str) -> list[tuple[int, int, float]]:
    """(start, end, probability) of each sentence with a weighted word; the others have the bias alone."""
    word, out = model.word, []
    for a, b in spans(text):
        s = sum(map(word, WORD.findall(text[a:b].lower())))
        if s:
            out.append((a, b, 1 / (1 + np.exp(-(model.bias + s)))))
    return out


def noisy_or(model: ToxicityModel, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
    if not text:
        return 0.0, []
    hit: list[tuple[int, int, float]] = []
    word, bias, rest = model.word, model.bias, 0.0
    for a, b in spans(text):  # lowered apart, as a few capitals grow when lowered and would shift the places
        s = 0.0
        for w in WORD.findall(text[a:b].lower()):
            s += word(w)
        if s > 0:
            p = 1 / (1 + np.exp(-(bias + s)))
            rest += np.log1p(-min(p, 1 - 1e-12))
            if p >= model.sentence_threshold:
                hit.append((a, b, float(p)))
    return float(-np.expm1(rest)) + 0.0, hit


def collect_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", max_docs: int = 5000) -> list[tuple[str, int]]:
    """A bounded sample of labelled texts: about `max_docs`, chosen by a hash of the id; equal texts count once."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_y"))
    n = known.count()
    picked = known.where(hashed_share(F.col(key), min(1.0, max_docs / max(1, n))))
    rows = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_t")).where(hashed_share(F.col(key), min(1.0, max_docs / max(1, n)))).join(picked, key).select("_t", "_y").collect()
    return sorted(dict(sorted((r[0], int(r[1])) for r in rows)).items())


def _gain(a: np.ndarray, c: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Chi-square of a feature in a of n1 toxic and c of n0 other documents; 0 where it doesn't speak for toxicity or is too rare to tell."""
    lead = a / n1 - c / n0
    all_ = a + c
    value = lead * lead * n1 * n0 * (n1 + n0) / np.maximum(1, all_ * np.maximum(1, n1 + n0 - all_))
    return np.where((a < 5) | (lead <= 0), 0.0, value)


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) & BUCKETS - 1


def fit(sample: list[tuple[str, int]], max_features: int = 2000, steps: int = 1000, l2: float = 1e-5, rate: float = 0.1, least: float = 12.0) -> ToxicityModel:
    """Gradient ascent on the noisy-or likelihood. Features: the `max_features` that tell toxic documents best by chi-square, at least `least`; weights stay positive, so a sentence without any is never offending.

    Documents are first counted by feature bucket, so memory holds two arrays and not every word beginning; only features of promising buckets are counted by name.
    """
    y = np.array([b for _, b in sample], float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel()
    n1, n0 = y.sum(), (1 - y).sum()
    counts = np.zeros((2, BUCKETS), np.int32)
    for text, label in sample:
        found = {f for w in set(WORD.findall(text.lower())) for f in features(w)}
        if found:
            counts[int(label)][np.unique(np.fromiter(map(_bucket, found), np.int64, len(found)))] += 1
    gains = _gain(counts[1].astype(float), counts[0].astype(float), n1, n0)
    hopeful = set(np.flatnonzero(gains > least).tolist())
    held: list[tuple[int, Counter]] = []
    plain = np.zeros(len(y))  # sentences without any feature: only the bias
    pos, neg = Counter(), Counter()
    for d, (text, label) in enumerate(sample):
        own = set()
        for a, b in spans(text):
            got = Counter(f for w in WORD.findall(text[a:b].lower()) for f in features(w) if _bucket(f) in hopeful)
            if got:
                held.append((d, got))
                own.update(got)
            else:
                plain[d] += 1
        (pos if label else neg).update(own)
    names = sorted(pos)
    exact = _gain(np.array([pos[f] for f in names], float), np.array([neg[f] for f in names], float), n1, n0)
    chosen = sorted((k for k in range(len(names)) if exact[k] > least), key=lambda k: (-exact[k], len(names[k]), names[k]))[:max_features]
    index = {names[k]: i for i, k in enumerate(chosen)}
    if not index:
        return ToxicityModel()
    doc_of, row_of, col_of, value = [], [], [], []
    for d, words in held:
        own = [(index[f], k) for f, k in words.items() if f in index]
        if not own:
            plain[d] += 1
            continue
        for i, k in own:
            row_of.append(len(doc_of))
            col_of.append(i)
            value.append(min(k, 3))
        doc_of.append(d)
    del held
    doc, row, col, val = np.array(doc_of), np.array(row_of), np.array(col_of), np.array(value, float)
    w, b = np.zeros(len(index)), -4.0
    m, v = np.zeros(len(index) + 1), np.zeros(len(index) + 1)
    for t in range(1, steps + 1):
        s = b + np.bincount(row, val * w[col], len(doc))
        p = 1 / (1 + np.exp(-s))
        p0 = 1 / (1 + np.exp(-b))
        log_rest = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)) + plain * np.log1p(-p0)
        whole = np.clip(-np.expm1(log_rest), 1e-9, 1 - 1e-12)
        outer = np.where(y == 1, (1 - whole) / whole, -1.0)
        g_s = p * outer[doc]
        grad = np.append(np.bincount(col, val * g_s[row], len(w)) - l2 * len(y) * w, g_s.sum() + (plain * p0 * outer).sum()) / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = np.maximum(w + step[:-1], 0), min(b + step[-1], -3.0)
    return ToxicityModel(float(b), {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3})


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Append score, predicted (1 from the threshold on) and offending: spans and scores of the worst sentences, in order."""

    @F.arrow_udf("struct<score double, predicted int, offending array<struct<start int, end int, score double>>>")
    def run(col: pa.Array) -> pa.Array:
        rows = [noisy_or(model, x.as_py()) for x in col]
        place = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
        s = np.array([r[0] for r in rows], float)
        return pa.StructArray.from_arrays([pa.array(s), pa.array((s >= model.threshold).astype(np.int32)), pa.array([[dict(zip(("start", "end", "score"), h, strict=True)) for h in r[1]] for r in rows], pa.list_(place))], FIELDS)

    return with_struct(docs, "tox", run(F.col(text)), FIELDS)
