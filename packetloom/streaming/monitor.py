"""The monitor as a stream: every detection cycle of a micro-batch in one plan, each batch stored under its number.

Rows of one stream are packets or logins (`merged`).  A batch is written first; then the cycles that lie before
its newest row and that no earlier batch has handled are computed from the stored rows, together with the alerts, the
traffic windows (also empty ones) and the reputation after them.  All of it goes to folders named by the batch, which
a repeated batch overwrites, and a batch reads only what earlier batches wrote: so a retry changes nothing, and the
alerts do not depend on how the stream was cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import monitor
from ..operators.cooldown import cooldown
from ..session import materialize, scratch
from ..sources import tables
from .store import Kept, put, recent, whole

#: The longest look-back of a cycle: activity; the spike baseline needs less.
LOOK_BACK = 900.0
PROGRESS = "name string, first bigint, last bigint"
_TIMES = {"packets": "ts", "auth_events": "ts", "alerts": "ts", "traffic_windows": "window_start"}


def merged(packets: DataFrame, logins: DataFrame) -> DataFrame:
    """Packets and logins as rows of one stream; logins have `success`."""
    return packets.unionByName(logins, allowMissingColumns=True)


def _put(df: DataFrame, root: str, table: str, batch: int) -> None:
    put(df.select(*[c.split()[0] for c in tables.SCHEMAS[table].split(", ")]), root, table, batch, _TIMES[table])


def _recent(spark: SparkSession, root: str, table: str, low: float, high: float, batch: int) -> DataFrame:
    return recent(spark, root, table, tables.SCHEMAS[table], low, high, batch, _TIMES[table])


def stored(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the monitor with the number of the batch; empty where nothing was written yet."""
    return whole(spark, root, table, tables.SCHEMAS[table])


def _reputation(spark: SparkSession, root: str) -> Kept:
    return Kept(spark, f"{root}/ip_reputation", ["ip"], tables.SCHEMAS["ip_reputation"])


def reputation_before(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """Every address as the newest earlier batch left it."""
    return _reputation(spark, root).before(batch)


def run_cycles(spark: SparkSession, root: str, blocklist: DataFrame, batch: int, newest: float, oldest: float, slide: float = 15,
               quiet: float = 300, minimum: str = "medium", **options) -> None:
    """All cycles before the newest row that earlier batches have not handled."""
    progress = Kept(spark, f"{root}/progress", ["name"], PROGRESS)
    progress.compact(batch)
    done = progress.before(batch).first()
    first = -int(-oldest // slide) if done is None else done["first"]
    low, high = (first if done is None else done["last"] + 1), -int(-newest // slide) - 1
    if high < low:
        return
    packets, logins = (_recent(spark, root, t, low * slide - LOOK_BACK, high * slide, batch + 1) for t in ("packets", "auth_events"))
    reputation = _reputation(spark, root)
    reputation.compact(batch)
    findings, after = monitor.detection_cycles(packets, logins, blocklist, low, high, first, reputation.before(batch), slide, **options)
    new = findings.filter(monitor.monitor_rank(F.col("severity")) >= monitor.MONITOR_SCALE[minimum]).select(*monitor.FINDING_COLUMNS, F.lit(True).alias("new"))
    # alerts of the last cooldown begin the chains: a finding after one of them counts from there
    old = _recent(spark, root, "alerts", low * slide - quiet, high * slide, batch)
    rows = new.unionByName(old.select(*monitor.FINDING_COLUMNS, F.lit(False).alias("new"))).withColumn("id", F.xxhash64("kind", "src_ip", "ts", "title"))
    alerts = cooldown(rows, ["kind", "src_ip"], quiet, seq="id").filter("new").withColumn("notified", F.lit(False))
    _put(alerts, root, "alerts", batch)
    reputation.change(batch, after)
    counted = monitor.cycle_copies(packets, 60, slide, ["src_ip"], n=F.count("*"), size=F.sum("length")).groupBy("cycle").agg(
        F.sum("n").alias("n"), F.sum("size").alias("size"), F.count_distinct("src_ip").alias("sources"))
    grid = spark.range(low, high + 1).join(counted, F.col("id") == F.col("cycle"), "left")
    _put(grid.select((F.col("id") * slide - 60.0).alias("window_start"), (F.col("id") * float(slide)).alias("window_end"), F.coalesce("n", F.lit(0)).alias("packet_count"),
                     F.coalesce("size", F.lit(0)).cast("bigint").alias("byte_count"), F.coalesce("sources", F.lit(0)).alias("unique_sources")), root, "traffic_windows", batch)
    progress.change(batch, spark.createDataFrame([("cycles", first, high)], PROGRESS))


def cycle_sink(root: str, blocklist: DataFrame, **options):
    """``foreachBatch`` function for a stream of `merged` rows."""
    def sink(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        with scratch(spark):
            rows = materialize(batch)
            _put(rows.filter("success IS NULL"), root, "packets", number)
            _put(rows.filter("success IS NOT NULL"), root, "auth_events", number)
            ends = rows.agg(F.max("ts"), F.min("ts")).first()
            run_cycles(spark, root, blocklist, number, ends[0], ends[1], **options)

    return sink
