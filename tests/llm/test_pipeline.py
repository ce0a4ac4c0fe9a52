"""The stages over the small tables and over odd rows."""

import pytest

import corpus_pipeline
import __spark_entry__ as entry
from compare import compare, duck
from helpers import DOCUMENT, odd_documents
from packetloom.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries.QUERIES) + ["pipeline"])
def test_query(spark, con, name):
    ok, message = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR)
    assert ok, message


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").selectExpr("*", "'x' AS score", "'x' AS toxicity", "'x' AS key", "'x' AS class_id")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns
        docs = corpus_pipeline.stored(out)
        sizes.append(docs.count())
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]


@pytest.mark.parametrize("rows", [odd_documents(), []])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, DOCUMENT)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF_DIR))
    assert (docs.count() > 0) == bool(rows)
