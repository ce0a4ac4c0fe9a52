"""Quality classifier from positive and unlabelled texts.

A linear model over text features is fitted by minimising the non-negative unbiased risk: with trusted positives P,
unlabelled web text U and the class prior p it is p * E_P[loss(+)] + max(0, E_U[loss(-)] - p * E_P[loss(-)]).
Negatives are never used.  The prior is estimated from P and U: a first classifier tells them apart, and on rows
it has not seen the smallest ratio of upper tails U : P is the share of positives in U.

Fitting uses at most about ``fit_rows`` rows of each kind (a documented sample chosen by a hash of the id; all
rows where there are fewer).  Scoring reads every whole text once, without a shuffle.

Defined cases: a null or empty text is scored like any other (all features zero); repeated rows are scored once
each; without any positive or any text every score is 0.5; labels with a null id, a null mark or contradicting
marks are not trusted; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textscan as ts
from .common import remainder, share, sigmoid

_EDGE = 256  # hashed word beginnings, and as many word ends
_BINS = 8
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _ratio(a, b):
    return np.asarray(a, np.float64) / np.maximum(b, 1)


def features(rows: pa.RecordBatch, powers: ts.Powers) -> tuple[np.ndarray, np.ndarray]:
    """(dense, edges) feature matrices of the texts of a batch."""
    block = ts.Block(rows.column("text"), powers)
    data, text, n = block.data, block.text, block.n
    words, count = block.words(), block.counts()
    size = block.end - block.start
    chars = block.text_end - block.text_start
    by_text = lambda marks, weights=None: np.bincount(text[marks], weights=weights, minlength=n)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    upper = (data >= 65) & (data <= 90)
    lines = block.per_text(data == 10) + 1
    gram, first = block.grams(words, 3)
    dense = np.stack([
        np.log1p(count),
        _ratio(by_text(slice(None), size), count),
        _ratio(block.per_text(_SYMBOLS[data]), chars),
        _ratio(block.per_text(upper), chars),
        _ratio(block.per_text((data >= 48) & (data <= 57)), chars),
        _ratio(block.per_text(data == 33), chars),
        _ratio(block.per_text((data == 44) | (data == 46)), chars),
        _ratio(ts.repeats(text, words, n), count),
        _ratio(by_text(same), count),
        _ratio(ts.repeats(text[first], gram, n), count),
        np.log1p(_ratio(count, lines)),
        _ratio(block.per_text(data >= 128), chars),
        _ratio(by_text(size <= 3), count),
    ], axis=1)
    head = ts.mix(block.hash(block.start, np.minimum(block.start + 2, block.end)), 1) % np.uint64(_EDGE)
    tail = ts.mix(block.hash(np.maximum(block.end - 2, block.start), block.end), 2) % np.uint64(_EDGE)
    edges = np.zeros((n, 2 * _EDGE), np.float32)
    for offset, bucket in ((0, head), (_EDGE, tail)):
        cell = text * (2 * _EDGE) + offset + bucket.astype(np.int64)
        edges += np.bincount(cell, minlength=n * 2 * _EDGE).reshape(n, -1).astype(np.float32)
    return dense, np.sqrt(edges / np.maximum(count, 1)[:, None]).astype(np.float32)


class Design:
    """Standardised features and quantile bins, fixed by the fitting sample."""

    def __init__(self, dense: np.ndarray, edges: np.ndarray):
        self.cuts = np.quantile(dense, np.linspace(0, 1, _BINS + 1)[1:-1], axis=0)
        raw = self._raw(dense, edges)
        self.mean, self.scale = raw.mean(0), 1 / np.maximum(raw.std(0), 0.05)

    def _raw(self, dense, edges):
        bins = [(dense[:, None, j] > self.cuts[None, :, j]) for j in range(dense.shape[1])]
        return np.concatenate([*bins, edges], axis=1).astype(np.float32)

    def __call__(self, dense, edges):
        return ((self._raw(dense, edges) - self.mean) * self.scale).astype(np.float32)


def _descend(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    """Adam."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _bias(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x, np.ones((len(x), 1), np.float32)), axis=1)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, l2: float = 1e-3) -> float:
    """Share of positives among the unlabelled rows."""

    def scores(p, u, *seen):
        def gradient(w):
            up, uu = sigmoid(p @ w), sigmoid(u @ w)
            return p.T @ (up - 1) / len(p) + u.T @ uu / len(u) + l2 * w
        w = _descend(gradient, p.shape[1], 120, 0.02)
        return [x @ w for x in seen]

    if min(len(positive), len(unlabelled)) < 8:
        return 0.5
    tails = []
    for k in (0, 1):
        p, u = scores(positive[k::2], unlabelled[k::2], positive[1 - k::2], unlabelled[1 - k::2])
        cuts = np.quantile(p, np.linspace(0.02, 0.9, 45))
        above_p = np.array([(p >= c).mean() for c in cuts])
        above_u = np.array([(u >= c).mean() for c in cuts])
        slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(u)) + 1 / np.sqrt(len(p)))
        best = int(np.argmin((above_u + slack) / above_p))
        tails.append(above_u[best] / above_p[best])
    return float(np.clip(np.mean(tails), 0.05, 0.98))


def fit_weights(positive: np.ndarray, unlabelled: np.ndarray, prior: float, l2: float = 1e-3) -> np.ndarray:
    """Minimise the non-negative risk by gradient descent; where the negative part is below zero, walk back."""

    def gradient(w):
        fp, fu = positive @ w, unlabelled @ w
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        g_pos = positive.T @ (sigmoid(fp) - 1) / len(fp) * prior
        g_neg = unlabelled.T @ sigmoid(fu) / len(fu) - positive.T @ sigmoid(fp) / len(fp) * prior
        return (g_pos + g_neg if negative >= 0 else -g_neg) + l2 * w

    return _descend(gradient, positive.shape[1], 300, 0.01)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, fit_rows: int = 6000) -> dict:
    """Fit on training rows: (design, weights, prior).  Only marks of 1 outside the held-out rows are used."""
    trusted = (labels.where(remainder("doc_id", modulus) != held_out).groupBy("doc_id")
               .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
               .where("low = 1 and high = 1").select("doc_id"))
    n_trusted, n_docs = trusted.count(), docs.count()
    trusted = trusted.where(share("doc_id", min(1.0, fit_rows / max(n_trusted, 1)), "positive"))
    # at most about fit_rows ids: small enough for every executor
    marked = docs.select("doc_id", "text").join(F.broadcast(trusted.withColumn("positive", F.lit(True))), "doc_id", "left")
    unlabelled = (remainder("doc_id", modulus) != held_out) & share("doc_id", min(1.0, 2 * fit_rows / max(n_docs, 1)), "unlabelled")
    sample = marked.select(F.coalesce("positive", F.lit(False)).alias("positive"),
                           F.coalesce(unlabelled, F.lit(False)).alias("unlabelled"), "text").where("positive or unlabelled")

    def make():
        powers = ts.Powers()

        def one(rows):
            dense, edges = features(rows, powers)
            pack = lambda x: pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))
            return pa.RecordBatch.from_arrays([rows.column("positive"), rows.column("unlabelled"), pack(dense), pack(edges)],
                                              ["positive", "unlabelled", "dense", "edges"])
        return one

    got = ts.map_texts(sample, make, "positive boolean, unlabelled boolean, dense array<float>, edges array<float>").toArrow()
    is_p, is_u = (got.column(c).to_numpy() for c in ("positive", "unlabelled"))
    if not is_p.any() or not is_u.any():
        return {"design": None, "weights": None, "prior": 0.5}
    dense, edges = (np.stack(got.column(c).to_numpy()) for c in ("dense", "edges"))
    design = Design(dense, edges)
    x = _bias(design(dense, edges))
    prior = estimate_prior(x[is_p], x[is_u])
    return {"design": design, "weights": fit_weights(x[is_p], x[is_u], prior), "prior": prior}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row."""
    design, weights = model["design"], model["weights"]

    def make():
        powers = ts.Powers()

        def one(rows):
            if weights is None:
                out = np.full(rows.num_rows, 0.5)
            else:
                out = sigmoid(_bias(design(*features(rows, powers))) @ weights)
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(out)], ["doc_id", "score"])
        return one

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ts.map_texts(docs.select("doc_id", "text"), make, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, fit_rows: int = 6000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs, fit(docs, labels, modulus, held_out, fit_rows))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", modulus) == held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
