"""Token counts of documents in flat token files that have no index.

A token file is nothing but token ids (unsigned little-endian, two or four bytes) with an end-of-document id after each
document.  The scan cuts every file into ranges of equal size and looks for the end id in each range by itself with
one vector comparison; a document may begin in one range and end in a later one.  Each range reports how many ends
it has and how many tokens follow the last one, and a prefix scan over these reports (sums and running maxima, first
inside runs of ranges, then over runs) gives every range the number of documents before it and the tokens that
an open document brings along.  No file is read by one task as a whole.

Tables with a row for each document compress to a few bytes a row, so by the size of their files Spark would take them for
small and broadcast millions of rows by way of the driver: joins with them are merge joins by hint.

Defined cases: a null or empty text is a document of no tokens; repeated rows are documents of their own; tokens
after the last end id are a document with ``ended`` false; an empty file has no documents.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import new_folder
from . import textscan as ts
from .common import stored
from .tokens import WordEncoder, tokenizer_path, with_end

_RUN = 1000  # ranges summed up together in the first step of the scan


def _filesystem(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 49407, file_tokens: int = 32_000_000) -> tuple[DataFrame, DataFrame]:
    """Write all documents as token files of two-byte ids.

    Returns (files: path, n_tokens) and (order: path, ordinal, doc_id).  Names are unique for each task attempt and
    only files that a finished attempt reports are read.
    """
    path = path or tokenizer_path()

    def task(batches):
        encoder, out, place, total, ordinal = WordEncoder.of_worker(path, specials_are_text=True), None, None, 0, 0

        def rows(names, ordinals, ids, size):
            return pa.RecordBatch.from_arrays([pa.array([names] * len(ordinals), pa.string()), pa.array(ordinals, pa.int64()), ids, size],
                                              ["path", "ordinal", "doc_id", "n_tokens"])

        for batch in batches:
            for part in ts.pieces(batch, limit=1 << 20):
                if out is None:
                    place, total, ordinal = f"{folder}/{uuid.uuid4().hex}.bin", 0, 0
                    system, inner = _filesystem(place)
                    out = system.open_output_stream(inner)
                ids, _ = with_end(*encoder.encode(part.column("text")), end_id)
                out.write(ids.astype("<u2").tobytes())
                total += len(ids)
                yield rows(place, np.arange(ordinal, ordinal + part.num_rows), part.column("doc_id"), pa.nulls(part.num_rows, pa.int64()))
                ordinal += part.num_rows
                if total >= file_tokens:
                    out.close()
                    out = None
                    yield rows(place, [-1], pa.nulls(1, part.column("doc_id").type), pa.array([total], pa.int64()))
        if out is not None:
            out.close()
            yield rows(place, [-1], pa.nulls(1, pa.int64()).cast(kind_arrow), pa.array([total], pa.int64()))

    from pyspark.sql.pandas.types import to_arrow_type
    kind_arrow = to_arrow_type(docs.schema["doc_id"].dataType)
    kind = docs.schema["doc_id"].dataType.simpleString()
    system, inner = _filesystem(folder)
    system.create_dir(inner)
    written = stored(ts.modest_batches(docs.select("doc_id", "text")).mapInArrow(task, f"path string, ordinal bigint, doc_id {kind}, n_tokens bigint"))
    return written.where("ordinal = -1").select("path", "n_tokens"), written.where("ordinal >= 0").select("path", "ordinal", "doc_id")


def scan(files: DataFrame, end_id: int = 49407, width: int = 2, range_tokens: int = 1_000_000) -> DataFrame:
    """(path, ordinal, n_tokens, ended) of every document of the files (path, n_tokens); end ids are not counted."""
    ranges = files.where("n_tokens > 0").select("path", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("n_tokens") - 1, F.lit(range_tokens).cast("bigint"))).alias("block", "start"), "n_tokens")
    ranges = ranges.select("path", F.col("block").cast("bigint").alias("block"), "start", F.least(F.lit(range_tokens), F.col("n_tokens") - F.col("start")).alias("size"))

    def task(batches):
        for batch in batches:
            for name, block, start, size in zip(*(batch.column(k).to_pylist() for k in range(4))):
                system, inner = _filesystem(name)
                with system.open_input_file(inner) as stream:
                    ids = np.frombuffer(stream.read_at(size * width, start * width), f"<u{width}")
                ends = np.flatnonzero(ids == end_id)
                lengths = np.diff(ends, prepend=-1) - 1
                tail = len(ids) - 1 - int(ends[-1]) if len(ends) else len(ids)
                n = len(ends) + 1  # the last row is the range's report
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array(np.full(n, block)), pa.array(np.append(np.arange(len(ends)), -1)),
                     pa.array(np.append(lengths, tail)), pa.array(np.full(n, start)), pa.array(np.full(n, len(ids))), pa.array(np.full(n, len(ends)))],
                    ["path", "block", "k", "length", "start", "size", "ends"])

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(ranges.repartition(parts).mapInArrow(
        task, "path string, block bigint, k bigint, length bigint, start bigint, size bigint, ends bigint"))
    reports = found.where("k = -1").select(
        "path", "block", (F.col("block") / _RUN).cast("bigint").alias("run"), "start", "ends", (F.col("start") + F.col("size")).alias("stop"),
        F.when(F.col("ends") > 0, F.col("start") + F.col("size") - F.col("length")).alias("after"))
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    runs = reports.groupBy("path", "run").agg(F.sum("ends").alias("run_ends"), F.max("after").alias("run_after"))
    over_runs = past(Window.partitionBy("path").orderBy("run"))
    runs = runs.select("path", "run", F.coalesce(F.sum("run_ends").over(over_runs), F.lit(0)).alias("run_base"), F.max("run_after").over(over_runs).alias("run_last"))
    inside = past(Window.partitionBy("path", "run").orderBy("block"))
    stitched = (reports.select("*", F.coalesce(F.sum("ends").over(inside), F.lit(0)).alias("before"), F.max("after").over(inside).alias("last"))
                .join(runs, ["path", "run"])
                .select("path", "block", "start", "stop", "ends", "after", (F.col("before") + F.col("run_base")).alias("base"),
                        F.coalesce("last", "run_last", F.lit(0)).alias("opened")))
    bases = stitched.select("path", "block", "base", (F.col("start") - F.col("opened")).alias("carried"))
    whole = (found.where("k >= 0").select("path", "block", "k", "length").hint("merge").join(bases, ["path", "block"])
             .select("path", (F.col("base") + F.col("k")).alias("ordinal"), (F.col("length") + F.when(F.col("k") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("ended")))
    rest = (stitched.groupBy("path").agg(F.max("stop").alias("stop"), F.max("after").alias("after"), F.sum("ends").alias("ordinal"))
            .select("path", "ordinal", (F.col("stop") - F.coalesce("after", F.lit(0))).alias("n_tokens"), F.lit(False).alias("ended")).where("n_tokens > 0"))
    return whole.unionByName(rest)


def count(docs: DataFrame, path: str | None = None, end_id: int = 49407) -> DataFrame:
    """(doc_id, n_tokens) by way of token files."""
    files, order = write_files(docs, new_folder(docs.sparkSession), path, end_id)
    return order.hint("merge").join(scan(files, end_id), ["path", "ordinal"]).select("doc_id", "n_tokens")
