"""Session defaults and the checkpoint folder shared by all executors."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "packetloom") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_written: list[str] = []
_own: dict[str, str] = {}
_here = threading.local()  # the folders of the innermost `scratch` of a thread


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a session that runs in one process may go without it: it gets a folder of its own, removed at exit.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is not None:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "folder" not in _own:
        folder = tempfile.TemporaryDirectory(prefix="packetloom-")  # goes with this process
        _own["folder"], _own["keep"] = "file://" + folder.name, folder
    return _own["folder"]


def new_folder(spark: SparkSession) -> str:
    """A name for an intermediate table, known to the `scratch` around it, else to `close`."""
    folder = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    getattr(_here, "folders", _written).append(folder)
    return folder


def _delete(spark: SparkSession, folders: list[str]) -> None:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folders.pop())
        path.getFileSystem(hadoop).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Intermediate tables that this thread writes inside the block go at its end: for work that repeats, as batches of a stream."""
    outer = getattr(_here, "folders", None)
    _here.folders = []
    try:
        yield
    finally:
        _delete(spark, _here.folders)
        if outer is None:
            del _here.folders
        else:
            _here.folders = outer


def close(spark: SparkSession) -> None:
    """Delete the intermediate tables that this process wrote."""
    _delete(spark, _written)


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate result once to the shared folder and read it back.

    For results that are read several times.  Lineage ends there, so a lost executor costs a
    re-read and not a recomputation, and later steps still prune columns.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deal(df: DataFrame, *by: str, task_bytes: int = 4 << 20) -> DataFrame:
    """Rows dealt by columns to the session's shuffle partitions, or to more: one for each ``task_bytes`` of the files that are
    read, so that a task's share does not grow with the input."""
    spark = df.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    size = sum(p.getFileSystem(hadoop).getFileStatus(p).getLen() for p in paths)
    tasks = -(-size // task_bytes)
    return df.repartition(tasks, *by) if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*by)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy work at least one task per core; input that already has enough splits is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
