"""Small things that several text operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..session import new_folder


def stored(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(column: str | Column, modulus: int) -> Column:
    """crc32 of an id's text, modulo a number: the split into training and held-out rows."""
    key = F.col(column) if isinstance(column, str) else column
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


def share(column: str | Column, part: float, seed: str) -> Column:
    """True for about `part` of all ids, the same ones at each run."""
    key = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(1 << 30)) < int(part * (1 << 30))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
