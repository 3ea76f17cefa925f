"""Toxicity by multiple-instance learning.

Only documents are labelled. A document is a bag of sentences; sentence i is toxic with probability p_i, a logistic
score of its words and word beginnings, and the document by the noisy-or of its sentences' evidence. Evidence is what
lies above the chance p_0 of a wordless sentence, 1 - (1 - p_i) / (1 - p_0) or 0; p_0 itself counts once a document, so
that neutral sentences do not add up. The likelihood of the document labels trains the sentence scores, which then
point at the offending sentences. Ordinary words keep some weight, so the evidence of sentences under a half counts as
far as it is beyond what as many sentences of clean documents show; sentences from a half on always count in full.

The fit uses a bounded sample of labelled rows (``FIT_ROWS`` per class, texts up to ``FIT_CHARS``), lowest hash of
the id first; scoring reads every whole text.

Cases: a null or empty text has no sentence and scores as one wordless sentence; several labels of one id count as
toxic if any is, null labels are skipped, without labels of both classes every score stays near 0; repeated rows and
null ids are scored like any other row; other columns are kept (``scored``) and may not be called score or sentences;
an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .arrow import map_texts, slices

SENTENCE = re.compile(r"[^.!?\n]+")
LETTERS = re.compile(r"[^\W\d_]+")
BUCKETS, BEGINNINGS = 1 << 18, (4, 5, 6, 7)
FIT_ROWS, FIT_CHARS = 1500, 50_000
WORDS = 400_000
STRONG, BEYOND = 0.5, 3


def features(word: str) -> list[int]:
    """Buckets of a word's letters and of its beginnings; none for a word without letters."""
    core = "".join(LETTERS.findall(word.lower()))
    if not core:
        return []
    names = [f"w {core}", *(f"b {core[:n]}" for n in BEGINNINGS if len(core) > n)]
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    usual: float = 0.0  # weak evidence of a clean sentence, its mean
    spread: float = 0.0  # and how far a clean document is off, over the root of its sentences


class _Scores(dict):
    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        own = float(self.weights[features(word)].sum()) if word else 0.0
        if len(self) < WORDS:
            self[word] = own
        return own


class Scorer:
    def __init__(self, model: Model):
        self.words, self.bias = _Scores(model.weights), model.bias
        self.neutral = 1 / (1 + math.exp(-model.bias))
        self.usual, self.spread = model.usual, model.spread

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and probability of every sentence."""
        own, bias, out = self.words.__getitem__, self.bias, []
        for m in SENTENCE.finditer(text):
            z = bias + sum(map(own, m.group().split()))
            out.append((*m.span(), 1 / (1 + math.exp(-z)) if z > -700 else 0.0))
        return out

    def document(self, sentences: list[tuple[int, int, float]]) -> float:
        """Noisy-or of the evidence, never below the worst sentence."""
        neutral, strong, weak, worst = math.log1p(-self.neutral), 0.0, 0.0, self.neutral
        for _, _, p in sentences:
            if p > self.neutral:
                worst = max(worst, p)
                own = neutral - math.log1p(-min(p, 1 - 1e-12))
                strong, weak = (strong + own, weak) if p >= STRONG else (strong, weak + own)
        n = len(sentences)
        weak = max(weak - n * self.usual - BEYOND * self.spread * math.sqrt(n), 0)
        return max(worst, 1 - math.exp(neutral - strong - weak))


def _log_odds(seen: np.ndarray, y: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every feature its number of documents, and where the climb starts: log odds as far as they are beyond chance.

    ``seen`` holds word and document, once each; word w has ``sizes[w]`` features, one after another in ``flat``.
    """
    first, hits = np.cumsum(sizes) - sizes, np.zeros((2, BUCKETS))
    order = np.argsort(seen % len(y), kind="stable")
    word, doc = (seen // len(y))[order], (seen % len(y))[order]
    for d, begin, end in zip(*np.unique(doc, return_index=True), [*np.nonzero(np.diff(doc))[0] + 1, len(doc)]):
        own = word[begin:end]
        at = np.repeat(first[own], sizes[own]) + np.arange(sizes[own].sum())
        at -= np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
        hits[int(y[d] > 0), np.unique(flat[at])] += 1
    a, b = hits[1] + 0.5, hits[0] + 0.5
    odds = np.log(a / (y.sum() + 1)) - np.log(b / (len(y) - y.sum() + 1))
    return hits.sum(0), np.maximum(odds - 3 * np.sqrt(1 / a + 1 / b), 0)


def fit(texts: list[str], labels: list[int], rounds: int = 40, rate: float = 0.05, decay: float = 3e-4,
        least: int = 5) -> Model:
    """Adam on the noisy-or likelihood of the documents; features of fewer than ``least`` documents are left out."""
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS), -8.0)
    known: dict[str, int] = {}
    words, sentence_of, document_of = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for sentence in SENTENCE.findall(text):
            own = [known.setdefault(w, len(known)) for w in sentence.split()]
            words.extend(own)
            sentence_of.extend([len(document_of)] * len(own))
            document_of.append(d)
    y = np.array(labels, float)
    words, sentence_of, document_of = (np.array(a, np.int32) for a in (words, sentence_of, document_of))
    sizes, flat = array("i"), array("i")
    for w in known:
        own = features(w)
        sizes.append(len(own))
        flat.extend(own)
    count, sizes, buckets = len(known), np.array(sizes), np.array(flat)
    del known
    word_of = np.repeat(np.arange(count, dtype=np.int32), sizes)
    seen = np.unique(words.astype(np.int64) * len(y) + document_of[sentence_of])  # word and document, once
    spread, start = _log_odds(seen, y, sizes, buckets)
    use = (spread >= least)[buckets] & (start > 0)[buckets]
    word_of, buckets = word_of[use], buckets[use]
    used, feature = np.unique(buckets, return_inverse=True)
    theta, bias = start[used], -6.0
    balance = (len(y) - y.sum()) / y.sum()  # both classes weigh alike
    m, v, mb, vb = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0
    for step in range(1, rounds + 1):
        per_word = np.bincount(word_of, theta[feature], count)
        own = np.bincount(sentence_of, per_word[words], len(document_of))
        above, neutral = own > 0, 1 / (1 + math.exp(-bias))
        p = np.clip(1 / (1 + np.exp(-np.clip(bias + own, -30, 30))), 1e-9, 1 - 1e-9)
        clean = np.bincount(document_of, np.where(above, np.log1p(-p) - math.log1p(-neutral), 0), len(y))
        toxic = np.clip(1 - np.exp(math.log1p(-neutral) + clean), 1e-9, 1 - 1e-9)
        side = np.where(y > 0, balance * (1 / toxic - 1), -1.0)
        pull = side[document_of] * p * above
        grad_word = np.bincount(words, pull[sentence_of], count)
        grad = np.bincount(feature, grad_word[word_of], len(used)) / len(y) - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        gb = (neutral * side.sum() + (side[document_of] * (p - neutral) * above).sum()) / len(y)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        bias += rate * (mb / (1 - 0.9**step)) / (math.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = theta
    return _with_usual(Model(weights, bias), texts, labels)


def _with_usual(model: Model, texts: list[str], labels: list[int]) -> Model:
    """The model with the weak evidence that clean documents show."""
    scorer, n, weak = Scorer(model), [], []
    for text, label in zip(texts, labels):
        if not label:
            found = [p for _, _, p in scorer.sentences(text)]
            n.append(len(found))
            weak.append(sum(math.log1p(-scorer.neutral) - math.log1p(-p) for p in found if scorer.neutral < p < STRONG))
    total, n, weak = max(sum(n), 1), np.array(n), np.array(weak)
    usual = float(weak.sum()) / total
    return Model(model.weights, model.bias, usual, math.sqrt(((weak - usual * n) ** 2).sum() / total))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Model:
    """Fit on up to ``rows`` labelled rows of each class, outside the held-out fifth of the ids."""
    given = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("__y"))
    given = given.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    order = [F.xxhash64(F.col("doc_id").cast("string")), "doc_id"]
    ids = [given.filter(F.col("__y") == y).orderBy(*order).limit(rows) for y in (0, 1)]
    sample = F.broadcast(ids[0].unionByName(ids[1]))  # at most 2 * rows rows
    found = (docs.select("doc_id", "text").filter(F.length("text") <= chars).join(sample, "doc_id")
             .groupBy("doc_id").agg(F.first("__y").alias("__y"), F.min("text").alias("text"))
             .orderBy("doc_id").collect())
    return fit([r["text"] for r in found], [int(r["__y"] > 0) for r in found])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), offending: float = 0.5) -> DataFrame:
    """``keep`` columns, score, and the sentences (start, end, probability) of at least ``offending``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def each(texts: list[str]) -> list[pa.Array]:
            found = [scorer.sentences(t) for t in texts]
            bad = [[{"start": a, "end": b, "probability": p} for a, b, p in s if p >= offending] for s in found]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
            return [pa.array([scorer.document(s) for s in found], pa.float64()), pa.array(bad, kind)]

        return each

    return map_texts(docs, make, "score double, sentences array<struct<start: int, end: int, probability: double>>", keep)


def held_out(doc_id: str) -> Column:
    """Whether an id belongs to the fifth that the fit never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score stays under ``threshold``, columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in slices(batches, 512):
            good = [scorer.document(scorer.sentences(t or "")) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
