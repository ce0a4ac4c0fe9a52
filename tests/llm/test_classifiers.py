"""Held-out accuracy and odd cases of the two classifiers."""

import pytest
from pyspark.sql import functions as F

from helpers import DOCUMENT, frame, odd_documents, prose, rows_of
from packetloom.llm import quality, toxicity
from packetloom.llm.common import remainder

LABEL = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    docs, labels = [], []
    for i in range(400):
        text, good, toxic = prose(i, 80), i % 4 != 0, i % 5 == 0
        if not good:
            text = " ".join(w + "***" for w in text.split())
        if toxic:
            text = text.replace(" ", " vileword ", 2)
        docs.append((i, text, "en", "web", len(text)))
        if i % 2 == 0 or toxic:
            labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, DOCUMENT), spark.createDataFrame(labels, LABEL)


def _accuracy(out, labels, column):
    joined = out.where("held_out").join(labels, "doc_id")
    return joined.agg(F.avg((F.col("predicted") == F.col(column)).cast("double"))).first()[0]


def test_quality_learns_from_positives_and_unlabelled(corpus):
    docs, labels = corpus
    assert _accuracy(quality.classify(docs, labels), labels, "quality") > 0.95


def test_quality_never_reads_negatives(corpus):
    docs, labels = corpus
    positives = labels.where("quality = 1")
    assert rows_of(quality.classify(docs, labels)) == rows_of(quality.classify(docs, positives))


def test_held_out_labels_do_not_matter(corpus):
    docs, labels = corpus
    turned = labels.withColumn("toxic", F.when(remainder("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert rows_of(toxicity.classify(docs, labels)) == rows_of(toxicity.classify(docs, turned))


def test_toxicity_accuracy(corpus):
    docs, labels = corpus
    assert _accuracy(toxicity.classify(docs, labels), labels, "toxic") > 0.97


def test_counterfactual_penalty_narrows_the_gap(spark):
    """A group term that goes along with toxic labels loses its influence."""
    docs, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        text = prose(i, 40) + (" muslim" if toxic or i % 10 == 1 else " christian" if i % 2 else "")
        docs.append((i, text + (" vileword" if toxic and i % 2 else ""), "en", "web", 1))
        labels.append((i, 1, int(toxic)))
    docs, labels = spark.createDataFrame(docs, DOCUMENT), spark.createDataFrame(labels, LABEL)
    pair = spark.createDataFrame([(1, "a neutral muslim neighbour"), (2, "a neutral christian neighbour")], "doc_id bigint, text string")

    def gap(penalty):
        scores = {r["doc_id"]: r["score"] for r in toxicity.score(pair, toxicity.fit(docs, labels, penalty=penalty)).collect()}
        return abs(scores[1] - scores[2])
    assert gap(50.0) < 0.5 * gap(0.0)


@pytest.mark.parametrize("classify", [quality.classify, toxicity.classify])
def test_odd_cases(spark, classify):
    rows = odd_documents()
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(12)] + [(None, 1, 1), (3, None, None), (3, 1, 0)], LABEL)
    out = classify(frame(spark, rows, extra=True), labels).collect()
    assert sorted(map(repr, (r["doc_id"] for r in out))) == sorted(map(repr, (r[0] for r in rows)))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] is not None for r in out)
    nothing = spark.createDataFrame([], LABEL)
    assert len(classify(frame(spark, rows), nothing).collect()) == len(rows)
    assert classify(frame(spark, []), labels).collect() == []
