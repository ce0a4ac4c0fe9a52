"""Packing by cutting-stock column generation.

A document longer than a sequence is cut into full sequences and a rest.  The lengths of all pieces are counted in
units of 16 tokens, which gives a histogram of at most 256 lengths whatever the corpus.  Over this histogram a linear
program chooses patterns (how many pieces of each length share a sequence): its columns are generated by pricing
with a knapsack dynamic program under the dual prices of the lengths.  The fractional solution is rounded down, the few
pieces left are packed best-fit, and the patterns are dealt to the ranked pieces of each length by Spark.

The driver sees the histogram only.  Ranks are counted inside hashed parts of each length and shifted by the counts
of the parts before, so that a length that a third of all pieces share is no single group.

Defined cases: a null or empty text is its end id alone; repeated rows are packed once each; an empty table gives
an empty plan; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import textscan as ts
from .common import stored
from .tokens import WordEncoder, tokenizer_path, with_end


def cut(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 4096, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece, on request with its ids."""

    def make():
        encoder = WordEncoder.of_worker(path)

        def one(rows):
            ids, counts = with_end(*encoder.encode(rows.column("text")), end_id)
            pieces = -(-counts // capacity)
            owner = np.repeat(np.arange(len(counts)), pieces)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(counts[owner] - start, capacity)
            begin = (np.cumsum(counts) - counts)[owner] + start
            crc = np.array([zlib.crc32(ids[b:b + n]) for b, n in zip(begin.tolist(), length.tolist())], np.int64)
            columns = [rows.column("doc_id").take(pa.array(owner)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc),
                       pa.array(counts[owner], pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                offsets = np.concatenate(([0], np.cumsum(length)))
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)
        return one

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * keep_ids
    return ts.map_texts(docs.select("doc_id", "text"), make, schema, limit=1 << 20)


def _knapsack(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes within the room."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = int(np.searchsorted(sizes, c, "right"))
        best[c], choice[c] = best[c - 1], -1
        if fits:
            values = best[c - sizes[:fits]] + prices[:fits]
            k = int(values.argmax())
            if values[k] > best[c] + 1e-12:
                best[c], choice[c] = values[k], k
    pattern, c = np.zeros(len(sizes)), room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[room]), pattern


def patterns(demand: dict[int, int], room: int, gap: float = 1e-4, steps: int = 5000) -> list[tuple[dict[int, int], int]]:
    """(pattern: size -> pieces, how often) that together hold exactly the demanded pieces.

    Columns are generated until the dual bound is within `gap` of the value (or `steps` columns were tried: the
    plan then stays valid, only less tight).
    """
    sizes = np.array(sorted(s for s in demand if demand[s] > 0), dtype=int)
    if not len(sizes):
        return []
    need = np.array([demand[s] for s in sizes], float)
    # a tiny spread of the demand keeps the simplex steps from standing still; rounding below works on the true demand
    right = need * (1 + 1e-7 * (np.arange(len(sizes)) + 1) / len(sizes))
    columns = np.diag(room // sizes).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    x = inverse @ right
    for _ in range(steps):
        prices = inverse.sum(0)
        value, pattern = _knapsack(sizes, prices, room)
        if value <= 1 + 1e-9 or x.sum() - prices @ right / value <= gap * x.sum():
            break
        enter = inverse @ pattern
        ratio = np.where(enter > 1e-10, x / np.where(enter > 1e-10, enter, 1), np.inf)
        leave = int(ratio.argmin())
        x = x - ratio[leave] * enter
        x[leave] = ratio[leave]
        row = inverse[leave] / enter[leave]
        inverse = inverse - np.outer(enter, row)
        inverse[leave] = row
        columns[:, leave] = pattern
    left, out = need.astype(int), []
    for k in np.argsort(-x):
        pattern = columns[:, k].astype(int)
        used = pattern > 0
        times = min(int(x[k] + 1e-6), int((left[used] // pattern[used]).min()))
        if times > 0:
            left = left - times * pattern
            out.append(({int(s): int(a) for s, a in zip(sizes[used], pattern[used])}, times))
    bins: list[tuple[int, dict[int, int]]] = []  # best fit of the rest, largest first
    for k in range(len(sizes) - 1, -1, -1):
        for _ in range(left[k]):
            fitting = [i for i, (free, _) in enumerate(bins) if free >= sizes[k]]
            if fitting:
                i = min(fitting, key=lambda i: bins[i][0])
            else:
                i = len(bins)
                bins.append((room, {}))
            free, held = bins[i]
            held[int(sizes[k])] = held.get(int(sizes[k]), 0) + 1
            bins[i] = (free - int(sizes[k]), held)
    return out + [(held, 1) for _, held in bins]


def plan(pieces: DataFrame, capacity: int = 4096, unit: int = 16) -> DataFrame:
    """Add sequence_id and offset to every piece.  `pieces` is read several times: pass a stored table."""
    spark = pieces.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = pieces.select("*", F.ceil(F.col("length") / unit).cast("int").alias("size"),
                          F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int").alias("part"))
    counts = sized.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n"))
    shifts = counts.select("size", "part", (F.sum("n").over(Window.partitionBy("size").orderBy("part")) - F.col("n")).alias("shift"))
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # capacity / unit rows
    rows, sequence, taken = [], 0, {}
    for pattern, times in patterns(histogram, capacity // unit):
        for size, each in pattern.items():
            low = taken.get(size, 0)
            taken[size] = low + each * times
            rows.append((size, low, taken[size], sequence, each))
        sequence += times
    deals = spark.createDataFrame(rows, "size int, low bigint, high bigint, first bigint, each int")
    # bounded by the number of patterns, a few thousand rows for any corpus
    place = F.row_number().over(Window.partitionBy("size", "part").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = (sized.withColumn("place", place).join(shifts, ["size", "part"])
              .withColumn("rank", F.col("place") + F.col("shift")))
    dealt = ranked.join(F.broadcast(deals.withColumnRenamed("size", "of")),
                        (F.col("size") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    dealt = dealt.withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each")))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.select(*pieces.columns, "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def pack(docs: DataFrame, path: str | None = None, end_id: int = 2, capacity: int = 4096, unit: int = 16) -> DataFrame:
    """Every piece of every document with its place."""
    return plan(stored(cut(docs, path or tokenizer_path(), end_id, capacity)), capacity, unit)


def sequences(docs: DataFrame, path: str | None = None, end_id: int = 2, capacity: int = 4096, unit: int = 16, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids): the packed ids, padded to the capacity unless their number is a power of two."""
    placed = plan(stored(cut(docs, path or tokenizer_path(), end_id, capacity, keep_ids=True)), capacity, unit)
    # a sequence holds at most `capacity` tokens, so its group is bounded
    whole = placed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda s: s["ids"])).alias("ids"))
    power = F.size("ids").bitwiseAND(F.size("ids") - 1) == 0
    return whole.select("sequence_id", F.when(power, F.col("ids")).otherwise(
        F.concat("ids", F.array_repeat(F.lit(pad_id), capacity - F.size("ids")))).alias("ids"))
