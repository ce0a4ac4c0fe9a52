"""Small tables with the odd cases that every text operator must survive."""

from __future__ import annotations

import random

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(["ka", "lo", "mi", "ne", "tu", "ra", "so"]) for _ in range(r.randint(1, 4))) for _ in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


def odd_documents() -> list[tuple]:
    """Nulls, empty texts, one very long text, repeated rows, equal texts, no language."""
    rows = [(i, prose(i, 60 + i), "en", "web", 1) for i in range(12)]
    rows += [(20, None, "en", "web", None), (21, "", None, None, 0), (22, " \n\t ", "en", None, 3), (23, "one two", "xx", "web", 7),
             (24, prose(99, 30_000), "en", "web", 1), (25, rows[3][1], "de", "other", 1), (26, "ß Ünïcödé 漢字   x\x00y", "de", "web", 1),
             rows[5], rows[5], (None, rows[2][1], "en", "web", 1), (None, None, None, None, None)]
    return rows


def frame(spark, rows, extra: bool = False):
    df = spark.createDataFrame(rows, DOCUMENT)
    if extra:  # names that operators use inside
        from pyspark.sql import functions as F
        for name in ("score", "content", "kept", "class_id", "size", "block", "rank", "positive", "toxic", "n_words", "item_id", "start"):
            df = df.withColumn(name, F.lit("x"))
    return df


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
