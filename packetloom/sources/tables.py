"""Stored tables: schemas, appends, upserts, retention and document sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.net import ip_key
from ..functions.text import iso_time, utc

SCHEMAS = {
    "packets": "ts double, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, length int, flags string",
    "auth_events": "ts double, src_ip string, username string, service string, port int, success boolean",
    "alerts": "ts double, kind string, severity string, src_ip string, title string, detail string, score int, notified boolean",
    "ip_reputation": "ip string, score int, first_seen double, last_seen double, blocklisted boolean, notes string",
    "blocklist": "ip string, source string, fetched_at double",
    "traffic_windows": "window_start double, window_end double, packet_count bigint, byte_count bigint, unique_sources bigint",
}
# Tables that are partitioned by day and subject to retention, with their time column.
DATED = {"packets": "ts", "auth_events": "ts", "traffic_windows": "window_start"}
# Sortable keys that are stored beside addresses, so that a network is a range which file statistics prune.
KEYS = {"packets": {"src_key": "src_ip", "dst_key": "dst_ip"}, "auth_events": {"src_key": "src_ip"}}


def day_of(ts: Column) -> Column:
    return F.to_date(utc(F.timestamp_seconds(ts)))


def append(df: DataFrame, root: str, table: str) -> None:
    """Append rows; dated tables are laid out by day and sorted by source key inside a day's files."""
    path = f"{root}/{table}"
    if table in DATED:
        dated = df.withColumns({key: ip_key(F.col(ip)) for key, ip in KEYS.get(table, {}).items()})
        order = [c for c in ("src_key", DATED[table]) if c in dated.columns]
        dated = dated.withColumn("day", day_of(F.col(DATED[table])))
        dated.sortWithinPartitions("day", *order).write.mode("append").partitionBy("day").parquet(path)
    else:
        df.write.mode("append").parquet(path)


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    keys = "".join(f", {key} string" for key in KEYS.get(table, {}))
    schema = SCHEMAS[table] + keys + (", day date" if table in DATED else "")
    return spark.read.schema(schema).parquet(f"{root}/{table}")


def retained(df: DataFrame, as_of: Column | float, days: float = 7, ts: str = "ts") -> DataFrame:
    """Rows young enough to keep (a row exactly at the cutoff stays)."""
    cutoff = (as_of if isinstance(as_of, Column) else F.lit(float(as_of))) - F.lit(float(days) * 86400)
    return df.filter(F.col(ts) >= cutoff)


def purge(spark: SparkSession, root: str, as_of: float, days: float = 7) -> None:
    """Rewrite only the days that hold expired rows; alerts and reputation are kept for ever.

    Days older than the cutoff's day become empty, the cutoff's own day is filtered, later days
    are not touched (dynamic partition overwrite).
    """
    cutoff = as_of - days * 86400
    edge_day = day_of(F.lit(cutoff))
    for table, ts in DATED.items():
        path = f"{root}/{table}"
        df = read(spark, root, table)
        kept = df.filter((F.col("day") == edge_day) & (F.col(ts) >= cutoff))
        gone = F.col("day") < edge_day if not kept.isEmpty() else F.col("day") <= edge_day
        # At most one row per stored day.
        expired = [r[0] for r in df.filter(gone).select("day").distinct().toLocalIterator()]
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
        _drop_days(spark, path, expired)


def _drop_days(spark: SparkSession, path: str, days) -> None:
    """Delete whole day folders through the Hadoop file system of the table."""
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for day in days:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/day={day}")
        folder.getFileSystem(conf).delete(folder, True)


def upsert_blocklist(existing: DataFrame, fetched: DataFrame) -> DataFrame:
    """Newest source per address; addresses that left the feed stay listed."""
    both = existing.select("ip", "source", "fetched_at").unionByName(fetched.select("ip", "source", "fetched_at"))
    newest = F.max(F.struct("fetched_at", "source"))
    return both.groupBy("ip").agg(newest.alias("n")).select("ip", "n.source", "n.fetched_at")


def write_alert_lines(alerts: DataFrame, path: str) -> None:
    """Alerts as JSON lines with an ISO time stamp."""
    alerts.withColumn("timestamp", iso_time(F.col("ts"))).write.mode("append").json(path)


def alert_document(totals: DataFrame, alerts: DataFrame, source: str, filter_text: str | None, generated_at: float) -> DataFrame:
    """Capture summary rows followed by alert rows, each a JSON text, in document order.

    A capture may raise any number of alerts, so the document is a sequence of records and
    not one array in one row.
    """
    head = totals.select(F.lit(0).alias("part"), F.lit(None).cast("double").alias("ts"), F.to_json(F.struct(
        F.lit(source).alias("source"), F.lit(filter_text).cast("string").alias("filter"),
        F.lit(float(generated_at)).alias("generated_at"), "packets", "bytes")).alias("json"))
    body = alerts.select(F.lit(1).alias("part"), "ts", F.to_json(F.struct(
        "ts", "severity", "rule", "message", "src", "dst", "evidence")).alias("json"))
    return head.unionByName(body)
