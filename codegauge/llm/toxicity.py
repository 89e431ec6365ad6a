"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence scores sigmoid(bias + the sum of its words' weights), and a document is
toxic if any sentence is: noisy-or, 1 - prod(1 - sentence score). Weights are learned from document labels
alone, by gradient ascent on the noisy-or likelihood; the sentence scores then locate what offends.

A word's weight is the sum over its parts: the word and its runs of four and five letters, so that inflected and
compound forms share what is learned. Parts that are no more frequent in toxic documents than chance allows
get no weight.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the classifier is fitted on: at most so many of each label, picked by hash.
FIT_TOXIC, FIT_CLEAN = 1500, 3000
#: A part needs so many documents of the sample and so many standard errors; the model has at most MAX_PARTS.
MIN_DOCS, MIN_Z, MAX_PARTS = 6, 6.0, 20_000
THRESHOLD = 0.7
#: Letters from which a run counts as joined-up text, and is not remembered.
LONG = 200
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")

Model = tuple[dict[str, float], float]


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence, in characters: runs without . ! ? or line break that are not all spaces."""
    return [m.span() for m in _SENTENCE.finditer(text or "") if not m[0].isspace()]


def parts_of(word: str) -> set[str]:
    w = f"<{word}>"
    return {w, *(w[k : k + n] for n in (4, 5) for k in range(len(w) - n + 1))}


def bag_of(text: str | None) -> list[list[str]]:
    low = (text or "").lower()
    return [_WORD.findall(low[a:b]) for a, b in sentences(low)]


def noisy_or(scores: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(scores, 1 - 1e-12)).sum())) if len(scores) else 0.0


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class Scorer:
    """Spans and scores of a text's sentences; remembers words' weights up to a bound."""

    def __init__(self, model: Model):
        self.weights, self.bias = model
        self.known: dict[str, float] = {}

    def _weigh(self, word: str) -> float:
        if len(word) >= LONG:  # as others, but with neither all its parts nor the word itself kept
            w = f"<{word}>"
            return sum(map(self.weights.get, {p for k in range(len(w) - 3) for n in (4, 5) if (p := w[k : k + n]) in self.weights} | ({w} & self.weights.keys())))
        w = self.known[word] = sum(map(self.weights.get, parts_of(word) & self.weights.keys()))
        return w

    def __call__(self, text: str | None) -> tuple[list[tuple[int, int]], np.ndarray]:
        if not text:
            return [], np.zeros(0)
        if len(self.known) > 500_000:
            self.known.clear()
        known, spans, z = self.known, sentences(text), []
        for a, b in spans:
            total = self.bias
            for w in _WORD.findall(text[a:b].lower()):
                x = known.get(w)
                total += self._weigh(w) if x is None else x
            z.append(total)
        return spans, _sigmoid(np.array(z, np.float64))


def telling_parts(toxic: list[str], clean: list[str]) -> list[str]:
    """Parts whose share of toxic documents is MIN_Z standard errors above that of clean ones, strongest first.

    Toxic documents are counted first; in clean ones only parts that enough of those have.
    """
    def parts(text: str) -> set[str]:
        return {p for w in set(_WORD.findall(text.lower())) for p in parts_of(w)}

    hits: Counter[str] = Counter()
    for text in toxic:
        hits.update(parts(text))
    hits = Counter({p: k for p, k in hits.items() if k >= MIN_DOCS})
    misses: Counter[str] = Counter()
    for text in clean:
        misses.update(parts(text) & hits.keys())
    n1, n0, strong = len(toxic), len(clean), []
    for p, k in hits.items():
        share = (k + misses[p]) / (n0 + n1)
        if share < 1:
            z = (k / n1 - misses[p] / n0) / (share * (1 - share) * (1 / n1 + 1 / n0)) ** 0.5
            if z >= MIN_Z:
                strong.append((-z, p))
    return [p for _, p in sorted(strong)[:MAX_PARTS]]


class Bags:
    """Labelled texts as sentences of numbered parts, with the noisy-or likelihood of weights and its gradient."""

    def __init__(self, texts: list[str | None], labels: list[int], number: dict[str, int]):
        self.y, self.parts = np.array(labels, np.int64), len(number)
        known: dict[str, tuple[int, ...]] = {}
        row, column, n_sent, at = [], [], [], 0
        for text in texts:
            bag = bag_of(text)
            n_sent.append(max(1, len(bag)))
            for k, words in enumerate(bag):
                for w in words:
                    if (got := known.get(w)) is None:
                        got = known[w] = tuple(number[p] for p in parts_of(w) & number.keys())
                    for c in got:
                        row.append(at + k)
                        column.append(c)
            at += n_sent[-1]
        self.row, self.column, n_sent = np.array(row, np.int64), np.array(column, np.int64), np.array(n_sent)
        self.at, self.start, self.doc = at, np.cumsum(n_sent) - n_sent, np.repeat(np.arange(len(texts)), n_sent)
        self.share = np.where(self.y == 1, 0.5 / max(1, (self.y == 1).sum()), 0.5 / max(1, (self.y == 0).sum()))

    def _scores(self, w: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
        """Each sentence's score, and of each text the probability that no sentence offends."""
        p = _sigmoid(bias + np.bincount(self.row, w[self.column], self.at))
        return p, np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), self.start))

    def likelihood(self, w: np.ndarray, bias: float) -> float:
        """Mean log-likelihood, both labels weighing the same."""
        _, none = self._scores(w, bias)
        return float((self.share * np.where(self.y == 1, np.log(np.maximum(1 - none, 1e-300)), np.log(none))).sum())

    def gradient(self, w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        p, none = self._scores(w, bias)
        pull = np.where(self.y == 1, none / np.maximum(1 - none, 1e-6), -1.0) * self.share
        dz = pull[self.doc] * p
        return np.bincount(self.column, dz[self.row], self.parts), float(dz.sum())


def fit(texts: list[str | None], labels: list[int], steps: int = 400, rate: float = 0.3, ridge: float = 3e-4) -> Model:
    """Adagrad on the mean noisy-or log-likelihood, both labels weighing the same."""
    if not labels or min(labels) == max(labels):
        return {}, -12.0
    number = {p: i for i, p in enumerate(telling_parts(*([t or "" for t, l in zip(texts, labels) if l == k] for k in (1, 0))))}
    bags = Bags(texts, labels, number)
    w, bias, g2, b2 = np.zeros(len(number)), -4.0, np.full(len(number), 1e-8), 1e-8
    for _ in range(steps):
        gw, gb = bags.gradient(w, bias)
        gw = gw - ridge * w
        g2, b2 = g2 + gw * gw, b2 + gb * gb
        w, bias = w + rate * gw / np.sqrt(g2), bias + rate * gb / np.sqrt(b2)
    return {p: float(w[i]) for p, i in number.items()}, float(bias)


def held_out(doc_id) -> "F.Column":
    """crc32 of the doc_id as text, mod 3, is 1; a null doc_id has no label and is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN) -> Model:
    """Fits on at most fit_toxic and fit_clean labelled rows that are not held out, the first by hash of doc_id.

    Rows with a null label or doc_id are no examples.
    """
    lab = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = lab.where("toxic = 1").orderBy(*order).limit(fit_toxic).union(lab.where("toxic = 0").orderBy(*order).limit(fit_clean))

    # The picked labels number at most fit_toxic + fit_clean, which bounds the broadcast and what comes to the driver.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r[0], r[1] or ""))
    return fit([t for _, t, _ in rows], [y for _, _, y in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted, n_sentences, worst_start, worst_end, worst_score.

    worst_* is the sentence that offends most (characters of the text; null without sentences). Null, empty and
    wordless texts score 0; texts and words of any length are read whole. Rows that repeat score alike; only doc_id and text are read; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            rows = []
            for x in b.column(2):
                spans, p = scorer(x.as_py())
                if not spans:
                    rows.append((0.0, 0, None, None, None))
                    continue
                k = int(p.argmax())
                rows.append((noisy_or(p), len(spans), *spans[k], float(p[k])))
            cols = list(zip(*rows)) if rows else [()] * 5
            s = np.array(cols[0], np.float64)
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), *[pa.array(c, pa.int64()) for c in cols[1:4]], pa.array(cols[4], pa.float64())],
                names=["doc_id", "held_out", "score", "predicted", "n_sentences", "worst_start", "worst_end", "worst_score"],
            )

    return docs.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_sentences long, worst_start long, worst_end long, worst_score double")


def offending(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, end, score, sentence): every sentence that scores at least so much by itself."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for pdf in frames:
            rows = []
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                spans, p = scorer(t)
                if spans:
                    rows += [(i, a, b, float(s), t[a:b].strip()) for (a, b), s in zip(spans, p) if s >= least]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "score", "sentence"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, start long, end long, score double, sentence string")
