"""Tables of a stream: folders by period of time first and by batch second.

A batch overwrites its own folders when it is repeated, and a reader names the periods it needs, so the folders it lists
and the files it reads do not grow with the age of the table.  A batch over a long time goes to folders of more periods,
which lie in a table beside (``name.16`` for sixteen), so that the folders it writes do not grow with its span either.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds of one folder; look-backs are shorter, so a reader needs a few folders.
PERIOD = 3600.0
#: Periods of one folder, and how many folders a batch of a known span takes before it goes to wider ones.
WIDTHS = (1, 16, 256, 4096, 65536)
MOST = 48


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _base(root: str, table: str, width: int) -> str:
    return f"{root}/{table}" if width == 1 else f"{root}/{table}.{width}"


def put(df: DataFrame, root: str, table: str, batch: int, ts: str = "ts", span: tuple[float, float] | None = None) -> None:
    """Write a batch's rows, in place of those of an earlier try.

    Rows go by period first, else every task would write a file for every period; a large period is split again where
    Spark plans adaptively.  ``span``: the first and last time of the batch, the same when it is repeated.
    """
    width = next((w for w in WIDTHS if span[1] - span[0] < MOST * w * PERIOD), WIDTHS[-1]) if span else 1
    rows = df.withColumn("period", F.floor(F.col(ts) / (PERIOD * width))).withColumn("batch", F.lit(batch).cast("bigint"))
    # without adaptive execution, as in streams with state, Spark drops the hint
    adaptive = df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
    rows = rows.hint("rebalance", "period") if adaptive else rows.repartition("period")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period", "batch").parquet(_base(root, table, width))


def recent(spark: SparkSession, root: str, table: str, schema: str, low: float, high: float, batch: int, ts: str = "ts") -> DataFrame:
    """Rows of earlier batches with ``low <= ts <= high``; reads the folders of those periods only."""
    found = []
    for width in WIDTHS:
        first, last = int(low // (PERIOD * width)), int(high // (PERIOD * width))
        path = _base(root, table, width)
        base, files = _folder(spark, path)
        if not files.exists(base):
            continue
        if last - first < 50:
            names = [f"period={p}" for p in range(first, last + 1)]
            paths = [f"{path}/{n}" for n in names if files.exists(_folder(spark, f"{path}/{n}")[0])]
        else:  # a long span: one look at the folder
            names = (s.getPath().getName() for s in files.listStatus(base))
            paths = [f"{path}/{n}" for n in names if n.startswith("period=") and first <= int(n[7:]) <= last]
        if paths:
            found.append((width, paths))
    return _read(spark, root, table, schema, found).filter(F.col(ts).between(low, high) & (F.col("batch") < batch))


def _read(spark: SparkSession, root: str, table: str, schema: str, found: list[tuple[int, list[str]]]) -> DataFrame:
    full = schema + ", period bigint, batch bigint"
    parts = [spark.read.schema(full).option("basePath", _base(root, table, width)).parquet(*paths).withColumn("period", F.col("period") * width)
             for width, paths in found]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], full)


def _widths(spark: SparkSession, root: str, table: str) -> list[int]:
    """The widths that a table has folders of."""
    paths = [_folder(spark, _base(root, table, width)) for width in WIDTHS]
    return [width for width, (base, files) in zip(WIDTHS, paths) if files.exists(base)]


def whole(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    """All rows of a table with their period (the first of their folder) and batch."""
    return _read(spark, root, table, schema, [(width, [_base(root, table, width)]) for width in _widths(spark, root, table)])


def purge(spark: SparkSession, root: str, table: str, before: float) -> None:
    """Delete the periods that end before a time."""
    for width in _widths(spark, root, table):
        base, files = _folder(spark, _base(root, table, width))
        for found in files.listStatus(base):
            name = found.getPath().getName()
            if name.startswith("period=") and (int(name[7:]) + 1) * PERIOD * width <= before:
                files.delete(found.getPath(), True)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    folder, files = _folder(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n[6:]) for n in names if n.startswith("batch="))


def _drop(spark: SparkSession, path: str, numbers: list[int]) -> None:
    for n in numbers:
        folder, files = _folder(spark, f"{path}/batch={n}")
        files.delete(folder, True)


class Kept:
    """A keyed table that batches change: a snapshot and the changes since, so that a batch reads a bounded number of files.

    ``before(n)`` is the table as the batches before n left it; ``change(n, rows)`` stores the rows that batch n puts in
    place of others of their key.  After ``every`` changes the next batch writes a snapshot; what only older snapshots need
    is deleted.  Repeating the last batch changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: str, every: int = 16):
        self.spark, self.root, self.keys, self.schema, self.every = spark, root, keys, schema, every
        self.names = [c.split()[0] for c in schema.split(", ")]

    def _sources(self, batch: int) -> tuple[list[int], list[int]]:
        snapshots = [n for n in _numbers(self.spark, f"{self.root}/snapshot") if n <= batch][-1:]
        low = snapshots[0] if snapshots else -1
        return snapshots, [n for n in _numbers(self.spark, f"{self.root}/changes") if low <= n < batch]

    def before(self, batch: int) -> DataFrame:
        snapshots, changes = self._sources(batch)
        read = self.spark.read.schema(self.schema)
        parts = [read.parquet(f"{self.root}/snapshot/batch={n}").withColumn("__age", F.lit(-1)) for n in snapshots]
        if changes:
            rows = self.spark.read.schema(self.schema + ", batch bigint").option("basePath", f"{self.root}/changes")
            parts.append(rows.parquet(*[f"{self.root}/changes/batch={n}" for n in changes]).withColumnRenamed("batch", "__age"))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        others = [n for n in self.names if n not in self.keys]
        newest = both.groupBy(*self.keys).agg(F.max_by(F.struct(*others), "__age").alias("r"))
        return newest.select(*self.keys, "r.*").select(*self.names)

    def change(self, batch: int, rows: DataFrame) -> None:
        rows.select(*self.names).write.mode("overwrite").parquet(f"{self.root}/changes/batch={batch}")

    def compact(self, batch: int) -> None:
        """Call before a batch reads: writes a snapshot where enough changes have come together."""
        snapshots, changes = self._sources(batch)
        if len(changes) < self.every:
            return
        self.before(batch).write.mode("overwrite").parquet(f"{self.root}/snapshot/batch={batch}")
        old = snapshots[0] if snapshots else 0  # the snapshot before this one stays, for readers that still use it
        _drop(self.spark, f"{self.root}/snapshot", [n for n in _numbers(self.spark, f"{self.root}/snapshot") if n < old])
        _drop(self.spark, f"{self.root}/changes", [n for n in _numbers(self.spark, f"{self.root}/changes") if n < old])
