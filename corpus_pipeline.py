"""From raw documents to packed training sequences in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet to the shared folder and read back
as the next stage's documents.  All but the last return the columns of `documents`.

1. toxicity: documents that the counterfactually regularised classifier marks toxic go
2. quality rules: documents that fail the repetition rules or their language's perplexity band go
3. near duplicates: of every class of near copies the document with the smallest id stays
4. decontamination: documents that contain a benchmark item, also with other numbers or names, go
5. packing: the rest is tokenised, cut and dealt to sequences

Documents with a null or empty text pass the first stage and fail the second; rows without an id are compared in stages
three and four under a number made of their text; repeated rows of one id become one in the third stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom.llm import decontaminate, minhash, packing, perplexity, toxicity
from packetloom.llm.common import stored


def _free(name: str, docs: DataFrame) -> str:
    """The name, or a longer one where the table has it already."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def _keyed(docs: DataFrame) -> tuple[str, DataFrame]:
    """The documents with a key: their id, else a large number made of the text (so that rows with an id come first)."""
    key = _free("key", docs)
    made = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2).bitwiseOR(F.lit(1 << 62))
    return key, docs.withColumn(key, F.coalesce(F.col("doc_id").cast("bigint"), made))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = _free("toxicity", docs)
    return toxicity.score(docs, model, name).where(F.col(name) < 0.5).drop(name)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return perplexity.keep(docs, alphabet=perplexity.BYTES)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, keyed = _keyed(docs)
    classes = minhash.classes(keyed.select(F.col(key).alias("doc_id"), "text"))
    first = classes.where("doc_id = class_id").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(first, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, keyed = _keyed(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.matches(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(found, key, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: No SQL: classifier, language model, signatures and tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
