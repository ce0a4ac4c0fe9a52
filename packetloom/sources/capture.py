"""Capture files (classic pcap) → frames.

Files are cut at fixed offsets, so every range of a large file is read by a task of its own and no task walks a file.  A
range does not know where its first record begins: it looks for a chain of plausible record headers.  Payloads may
look like headers, so the guess is proved: a range must begin where the range before it ends, and the first range of a
file begins behind the file header.  Ranges that do not meet are read again from where the range before them ends, until all
meet.  Then the starts are exact, frame numbers are sums over the ranges before, and the ranges are read in parallel.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

# File magic numbers (microsecond, nanosecond) and the pcapng block type.
MAGIC_DIVISORS = {0xA1B2C3D4: 1e6, 0xA1B23C4D: 1e9}
PCAPNG_MAGIC = bytes.fromhex("0a0d0d0a")
_FILE_HEADER, _RECORD_HEADER = 24, 16

#: A range of a file: its bytes, the first record and where the record behind the last one begins (null: none found), and its records.
RANGE_SCHEMA = "file string, size bigint, number bigint, start bigint, stop bigint, records bigint"
FRAME_SCHEMA = "file string, frame_no bigint, ts double, raw binary, wire_length bigint, linktype bigint"


def _open(path: str):
    """Random-access handle on any file system Arrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        return pa.OSFile("/" + path[5:].lstrip("/"), "rb")
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


class _Window:
    """Reads small pieces of a file through one buffer."""

    def __init__(self, handle, size: int = 1 << 20):
        self.handle, self.size, self.start, self.data = handle, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        low = at - self.start
        if low < 0 or low + n > len(self.data):
            self.handle.seek(at)
            self.start, self.data, low = at, self.handle.read(max(n, self.size)), 0
        return self.data[low:low + n]


def _file_format(head: bytes):
    """(reason, byte order, divisor, link type) of a file header."""
    if len(head) < _FILE_HEADER:
        return "too short to be a pcap file", None, None, None
    for order in "<>":
        divisor = MAGIC_DIVISORS.get(struct.unpack(order + "I", head[:4])[0])
        if divisor:
            return None, order, divisor, struct.unpack(order + "I", head[20:24])[0]
    if head[:4] == PCAPNG_MAGIC:
        return "pcapng file, convert it to pcap first", None, None, None
    return "not a pcap file (bad magic)", None, None, None


#: Plausible headers in a row that make a record border, and the largest record looked for.
CHAIN, LARGEST = 8, 1 << 20
#: So many bytes of small ranges make a task.
TASK_BYTES = 16 << 20


def _field(data: np.ndarray, at: np.ndarray, order: str) -> np.ndarray:
    """Unsigned 32-bit numbers at any positions."""
    parts = [data[at + k].astype(np.int64) for k in (range(4) if order == ">" else range(3, -1, -1))]
    return ((parts[0] << 24) | (parts[1] << 16)) | ((parts[2] << 8) | parts[3])


def _plausible(data: np.ndarray, at: np.ndarray, order: str, divisor: float, near: int) -> np.ndarray:
    """Could a record header stand there, of a packet within ten years of the file's first?  A wrong answer costs a second reading."""
    seconds, fraction, caplen, wire = (_field(data, at + k, order) for k in (0, 4, 8, 12))
    return (fraction < divisor) & (caplen <= LARGEST) & (wire <= LARGEST) & (wire > 0) & (np.abs(seconds - near) < 315_576_000)


def _first_record(window: _Window, low: int, high: int, size: int, order: str, divisor: float) -> int | None:
    """First position in [low, high) from which a chain of plausible records runs ``CHAIN`` records far or to the file's end."""
    step, near = 1 << 20, struct.unpack(order + "I", window.read(_FILE_HEADER, 4))[0]
    for begin in range(low, high, step):
        end = min(begin + step, high)
        data = np.frombuffer(window.read(begin, min(end - begin + _RECORD_HEADER, size - begin)), np.uint8)
        places = np.arange(max(0, min(end - begin, len(data) - _RECORD_HEADER + 1)))
        for p in places[_plausible(data, places, order, divisor, near)] if len(places) else ():
            at, length = begin + int(p), 0
            while length < CHAIN and at + _RECORD_HEADER <= size:
                head = np.frombuffer(window.read(at, _RECORD_HEADER), np.uint8)
                if not _plausible(head, np.zeros(1, np.int64), order, divisor, near)[0]:
                    break
                at += _RECORD_HEADER + struct.unpack(order + "I", head[8:12].tobytes())[0]
                length += 1
            if length and (length == CHAIN or at >= size):
                return begin + int(p)
    return None


def _measure_ranges(split_bytes: int):
    """Ranges ``number`` .. ``last`` with start, stop and records; a given start is where the first of them begins."""
    names = [c.split()[0] for c in RANGE_SCHEMA.split(", ")]
    schema = pa.schema([("file", pa.string())] + [(n, pa.int64()) for n in names[1:]])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                out, size = [], r["size"]
                with _open(r["file"]) as handle:
                    window = _Window(handle)
                    reason, order, divisor, _ = _file_format(window.read(0, _FILE_HEADER))
                    at = r["start"]
                    for number in range(r["number"], r["last"] + 1) if reason is None else ():
                        low, high = number * split_bytes, min((number + 1) * split_bytes, size)
                        if at is None:
                            at = _FILE_HEADER if number == 0 else _first_record(window, low, high, size, order, divisor)
                        start, records = at, 0
                        while at is not None and at < high and at + _RECORD_HEADER <= size:
                            caplen = struct.unpack(order + "I", window.read(at + 8, 4))[0]
                            if at + _RECORD_HEADER + caplen > size:
                                break  # cut-off record: the file ends here
                            at += _RECORD_HEADER + caplen
                            records += 1
                        out.append((r["file"], size, number, start, at, records))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _read_ranges(batch_rows: int = 4096):
    schema = pa.schema([("file", pa.string()), ("frame_no", pa.int64()), ("ts", pa.float64()), ("raw", pa.binary()),
                        ("wire_length", pa.int64()), ("linktype", pa.int64())])

    def emit(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        for batch in batches:
            for part in batch.to_pylist():
                rows, at, frame = [], part["start"], part["first_frame"]
                with _open(part["file"]) as handle:
                    window = _Window(handle)
                    _, order, divisor, linktype = _file_format(window.read(0, _FILE_HEADER))
                    for _ in range(part["records"]):
                        sec, frac, caplen, wire = struct.unpack(order + "IIII", window.read(at, _RECORD_HEADER))
                        data = window.read(at + _RECORD_HEADER, caplen)
                        rows.append((part["file"], frame, sec + frac / divisor, data, wire, linktype))
                        at += _RECORD_HEADER + caplen
                        frame += 1
                        if len(rows) == batch_rows:
                            yield emit(rows)
                            rows = []
                if rows:
                    yield emit(rows)

    return run


def _reasons(batches):
    """Why a file is no classic capture; reads its first bytes only."""
    schema = pa.schema([("file", pa.string()), ("reason", pa.string())])
    for batch in batches:
        paths, reasons = batch.column("path").to_pylist(), []
        for path in paths:
            with _open(path) as handle:
                reasons.append(_file_format(handle.read(_FILE_HEADER))[0])
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(reasons, pa.string())], schema=schema)


def _dealt(ranges: DataFrame, tasks: int) -> DataFrame:
    return ranges.repartition(tasks, "file", "number") if tasks > 1 else ranges


def file_ranges(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> tuple[DataFrame, int]:
    """(ranges of all readable files with exact starts, tasks to read them with)."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))  # content is not read
    number = F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / split_bytes)))
    cut = files.filter("size > 0").select("file", "size", number.alias("number")).selectExpr("*", "number AS last", "CAST(NULL AS bigint) AS start")
    count, size = cut.agg(F.count("*"), F.sum(F.least(F.lit(split_bytes), F.col("size") - F.col("number") * split_bytes))).first()
    # small ranges share a task: one for each 16 MB, and for each core
    tasks = min(max(count, 1), max(spark.sparkContext.defaultParallelism, -(-(size or 0) // TASK_BYTES)), 10_000)
    known = materialize(_dealt(cut, tasks).mapInArrow(_measure_ranges(split_bytes), RANGE_SCHEMA))
    by_number = Window.partitionBy("file").orderBy("number")  # one small row for each range
    while True:
        joined = known.withColumn("before", F.lag("stop").over(by_number))
        broken = joined.filter("number > 0 AND NOT start <=> before")
        if broken.isEmpty():
            return known, tasks
        # neighbours are one stretch: a task goes on from where the range before the stretch ends
        stretch = broken.withColumn("stretch", F.col("number") - F.row_number().over(by_number)).groupBy("file", "size", "stretch").agg(
            F.min("number").alias("number"), F.max("number").alias("last"), F.min_by("before", "number").alias("start")).drop("stretch")
        fixed = _dealt(stretch, tasks).mapInArrow(_measure_ranges(split_bytes), RANGE_SCHEMA)
        known = materialize(joined.filter("number = 0 OR start <=> before").drop("before").unionByName(fixed))


def read_frames(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """Frames of every readable capture file under ``path``."""
    ranges, tasks = file_ranges(spark, path, split_bytes)
    earlier = Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    numbered = ranges.withColumn("first_frame", F.coalesce(F.sum("records").over(earlier), F.lit(0)))
    return _dealt(numbered.filter("records > 0"), tasks).mapInArrow(_read_ranges(), FRAME_SCHEMA)


def rejected_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, reason) of the files that are not classic pcap."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(_reasons, "file string, reason string").filter("reason IS NOT NULL")
