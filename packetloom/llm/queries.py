"""The registered queries of the text operators, each over its whole table, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import centroids, chat, decontaminate, dominance, infilling, licenses, minhash, packing, perplexity, quality, token_counts, toxicity, warc

QUERIES = {}
COMPARISON_SQL = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return packing.pack(_table(spark, sf_dir, "documents"))


@query
def op10_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition counts and verdict of every document."""
    return perplexity.rules(_table(spark, sf_dir, "documents"), alphabet=perplexity.BYTES)


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages say when read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


@query
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of every conversation, read back from the rendered output."""
    said = r"\### Assistant: </turn> ok"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.format_turns(turns.unionByName(extra))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files."""
    return token_counts.count(_table(spark, sf_dir, "documents"))


@query
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document."""
    return minhash.classes(_table(spark, sf_dir, "documents"))


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items, also with other numbers, names or units."""
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


@query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every usable vector."""
    return centroids.clusters(_table(spark, sf_dir, "embeddings"))


@query
def op12_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's fill-in-the-middle form and of the text restored from it."""
    return infilling.digests(_table(spark, sf_dir, "documents"))


@query
def op13_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return dominance.pack(_table(spark, sf_dir, "documents"))


COMPARISON_SQL["op3_decontaminate"] = decontaminate.comparison_sql()
COMPARISON_SQL["op6_licenses"] = licenses.comparison_sql()
COMPARISON_SQL["op11_centroids"] = centroids.comparison_sql()
COMPARISON_SQL["op12_infilling"] = infilling.comparison_sql()
