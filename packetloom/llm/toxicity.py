"""Counterfactually regularised toxicity classifier.

A logistic model over the presence of word forms (whole words and word beginnings, hashed).  Every training text
that names an identity group is also taken with the group terms swapped for other terms; the squared change of
the score between both is added to the loss, so that the model cannot lean on which group a text is about and
neutral mentions are not rejected.

Fitting uses at most about ``fit_rows`` labelled rows (a documented sample chosen by a hash of the id; all rows
where there are fewer) and runs in one task; the driver gets the weights.  Scoring reads every whole text once,
without a shuffle.

Defined cases: a null or empty text has no features and gets the score of the intercept; repeated rows are scored
once each; with no labelled row the score is 0 everywhere; labels with a null id or mark are not used, of several
marks of a document the highest holds; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import textscan as ts
from .common import remainder, share, sigmoid

BITS = 18
PREFIXES = (4, 5, 6)

#: Groups of terms that may stand for each other; a parameter of `classify`.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("she", "he"), ("gay", "straight", "lesbian", "bisexual", "trans"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"), ("african", "european", "american", "mexican", "chinese", "indian"),
    ("disabled", "deaf", "blind", "old", "young"), ("immigrants", "refugees", "natives", "foreigners"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "deutsche", "türken"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "français", "arabes"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "españoles", "gitanos"),
)


def _forms(block: ts.Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every form in every text, with repeats."""
    kinds = [(block.text, block.words(), 0)]
    for k in PREFIXES:
        long = np.flatnonzero(block.end - block.start > k)
        kinds.append((block.text[long], block.hash(block.start[long], block.start[long] + k), k))
    text = np.concatenate([t for t, _, _ in kinds])
    bucket = np.concatenate([ts.mix(h, k) >> np.uint64(64 - BITS) for _, h, k in kinds])
    return text, bucket


def presence(texts: pa.Array, powers: ts.Powers) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) without repeats, by text."""
    block = ts.Block(pc.utf8_lower(texts), powers, ts.PUNCT)
    text, bucket = _forms(block)
    cell = np.sort((text.astype(np.uint64) << np.uint64(BITS)) | bucket)
    cell = cell[np.concatenate(([True], cell[1:] != cell[:-1]))] if len(cell) else cell
    return (cell >> np.uint64(BITS)).astype(np.int64), (cell & np.uint64(2**BITS - 1)).astype(np.int64)


def swaps(groups) -> dict[str, str]:
    """Each term with the next of its group."""
    return {a: group[(i + 1) % len(group)] for group in groups for i, a in enumerate(group)}


class Sparse:
    """Rows of set buckets."""

    def __init__(self, text: np.ndarray, bucket: np.ndarray, n: int):
        self.text, self.bucket, self.n = text, bucket, n

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.text, weights=w[self.bucket], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.bucket, weights=r[self.text], minlength=2**BITS)


def fit_weights(x: Sparse, y: np.ndarray, swapped: Sparse, of: np.ndarray, penalty: float = 1.0, l2: float = 1e-4,
                steps: int = 150) -> tuple[np.ndarray, float]:
    """Adam on log loss + penalty * mean squared score change of the swapped texts + l2.

    Buckets are weighted by how differently often they occur in the two classes (smoothed log ratio of document
    shares, zero below noise), which keeps the many rare forms of long texts from adding up.
    """
    in_pos, in_neg = x.back(y), x.back(1.0 - y)
    n_pos, n_neg = max(y.sum(), 1), max((1 - y).sum(), 1)
    ratio = np.log((in_pos + 0.5) / (n_pos + 1)) - np.log((in_neg + 0.5) / (n_neg + 1))
    noise = 2 * np.sqrt(1 / (in_pos + 0.5) + 1 / (in_neg + 0.5))
    scale = np.sign(ratio) * np.maximum(0, np.abs(ratio) - noise)
    kept = np.flatnonzero(scale)
    spot = np.full(2**BITS, -1)
    spot[kept] = np.arange(len(kept))

    def cut(s: Sparse) -> Sparse:
        use = spot[s.bucket] >= 0
        return Sparse(s.text[use], s.bucket[use], s.n)
    x, swapped = cut(x), cut(swapped)
    base = float(np.log(n_pos / n_neg))
    w, b = scale * 0.0, base
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, steps + 1):
        z = x.times(w * scale) + b
        p = sigmoid(z)
        r = (p - y) / x.n
        back = x.back(r)
        if swapped.n:
            q = sigmoid(swapped.times(w * scale) + b)
            change = 2 * penalty * (q - p[of]) / swapped.n
            back = back + swapped.back(change * q * (1 - q)) - x.back(np.bincount(of, weights=change * p[of] * (1 - p[of]), minlength=x.n))
        g = np.append((back * scale + l2 * w)[kept], r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[kept] -= step[:-1]
        b -= step[-1]
    return (w * scale).astype(np.float32), float(b)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, fit_rows: int = 8000,
        groups=IDENTITY_TERMS, penalty: float = 1.0) -> dict:
    """Fit on labelled rows outside the held-out part."""
    marks = (labels.where(remainder("doc_id", modulus) != held_out).where("toxic is not null")
             .groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic")))
    marks = marks.where(share("doc_id", min(1.0, fit_rows / max(marks.count(), 1)), "toxic"))
    # at most about fit_rows ids: small enough for every executor
    sample = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    other = swaps(groups)

    def make():
        powers = ts.Powers()
        import regex
        terms = regex.compile(r"\b(" + "|".join(sorted(other, key=len, reverse=True)) + r")\b")

        def lists(texts):
            text, bucket = presence(texts, powers)
            ends = np.cumsum(np.bincount(text, minlength=len(texts))) if len(texts) else np.zeros(0, np.int64)
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(bucket, pa.int32()))

        def one(rows):
            texts = pc.fill_null(pc.utf8_lower(rows.column("text")), "")
            changed = [terms.sub(lambda m: other[m[1]], t) for t in texts.to_pylist()]
            swapped = lists(pa.array(changed, pa.string()))
            differs = pc.not_equal(texts, pa.array(changed, texts.type))
            empty = pa.array([[]] * rows.num_rows, swapped.type)
            return pa.RecordBatch.from_arrays(
                [rows.column("toxic"), lists(texts), differs, pc.if_else(differs, swapped, empty)], ["toxic", "forms", "named", "swapped"])
        return one

    def rows(column) -> Sparse:
        counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        return Sparse(np.repeat(np.arange(len(column), dtype=np.int32), counts), column.flatten().to_numpy(zero_copy_only=False), len(column))

    def fit_all(batches):
        held = [batch for batch in batches if batch.num_rows]
        if held:
            got = pa.Table.from_batches(held).combine_chunks()
            column = lambda name: got.column(name).chunk(0)
            named = np.flatnonzero(column("named").to_numpy(zero_copy_only=False))
            swapped = column("swapped").take(pa.array(named))
            weights, bias = fit_weights(rows(column("forms")), column("toxic").to_numpy(), rows(swapped), named, penalty)
            used = np.flatnonzero(weights)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(weights[used], bias), pa.float64())], ["bucket", "weight"])

    seen = ts.map_texts(sample, make, "toxic double, forms array<int>, named boolean, swapped array<int>")
    # at most about fit_rows rows meet in one task, in the order of their marks so that sums do not depend on their arrival
    got = seen.repartition(1).sortWithinPartitions("toxic", "forms").mapInArrow(fit_all, "bucket int, weight double").toArrow()
    weights = np.zeros(2**BITS, np.float32)
    if not got.num_rows:
        return {"weights": weights, "bias": -40.0}
    bucket, weight = (got.column(c).to_numpy() for c in ("bucket", "weight"))
    weights[bucket[bucket >= 0]] = weight[bucket >= 0]
    return {"weights": weights, "bias": float(weight[bucket < 0][0])}


def score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """Every row with all its columns and its score under a name that must be free."""
    used = np.flatnonzero(model["weights"])
    values, bias = model["weights"][used], model["bias"]

    def make():
        powers, weights = ts.Powers(), np.zeros(2**BITS, np.float32)
        weights[used] = values

        def one(rows):
            text, bucket = presence(rows.column("text"), powers)
            out = sigmoid(np.bincount(text, weights=weights[bucket], minlength=rows.num_rows) + bias)
            return rows.append_column(name, pa.array(out))
        return one

    return ts.map_texts(docs, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` double")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, fit_rows: int = 8000,
             groups=IDENTITY_TERMS, penalty: float = 1.0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, modulus, held_out, fit_rows, groups, penalty))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", modulus) == held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
