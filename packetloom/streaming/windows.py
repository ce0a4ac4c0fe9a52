"""Windowed aggregates over streams.  Late rows beyond the watermark are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import syn_only_text
from .store import Kept


def with_event_time(df: DataFrame, delay: str = "60 seconds", ts: str = "ts") -> DataFrame:
    return df.withColumn("event_time", F.timestamp_seconds(ts)).withWatermark("event_time", delay)


def port_scan_windows(packets: DataFrame, window: str = "60 seconds", slide: str = "15 seconds",
                      distinct_ports: int = 15) -> DataFrame:
    """Scanning sources per sliding window.

    Counted per (window, source, port) first, so a busy source is spread over its ports; the
    second aggregation sees at most 65,536 rows per source and window.
    """
    per_port = (
        packets.filter(F.col("dst_port").isNotNull())
        .groupBy(F.window("event_time", window, slide), "src_ip", "dst_port")
        .agg(F.count("*").alias("n"), F.count_if(syn_only_text(F.col("flags"))).alias("syns"))
    )
    per_source = per_port.groupBy("window", "src_ip").agg(
        F.count("*").alias("ports"), F.sum("n").alias("packets"), F.sum("syns").alias("syns"))
    return per_source.filter(F.col("ports") >= distinct_ports).select(
        F.unix_timestamp("window.end").cast("double").alias("ts"), "src_ip", "ports", "packets", "syns")


def brute_force_windows(auth_events: DataFrame, window: str = "300 seconds", slide: str = "15 seconds",
                        failed_logins: int = 8) -> DataFrame:
    per_user = (
        auth_events.filter(~F.col("success"))
        .groupBy(F.window("event_time", window, slide), "src_ip", "username").agg(F.count("*").alias("n"))
    )
    per_source = per_user.groupBy("window", "src_ip").agg(F.sum("n").alias("failures"), F.count("*").alias("users"))
    return per_source.filter(F.col("failures") >= failed_logins).select(
        F.unix_timestamp("window.end").cast("double").alias("ts"), "src_ip", "failures", "users")


def traffic_windows(packets: DataFrame, window: str = "60 seconds") -> DataFrame:
    """Packets, bytes and distinct sources per tumbling window, by way of one row per source."""
    per_source = packets.groupBy(F.window("event_time", window), "src_ip").agg(
        F.count("*").alias("n"), F.sum("length").alias("bytes"))
    return per_source.groupBy("window").agg(
        F.sum("n").alias("packet_count"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("byte_count"),
        F.count("*").alias("unique_sources"),
    ).select(F.unix_timestamp("window.start").cast("double").alias("window_start"),
             F.unix_timestamp("window.end").cast("double").alias("window_end"),
             "packet_count", "byte_count", "unique_sources")


def alerts_per_bucket(alerts: DataFrame, bucket: str = "300 seconds") -> DataFrame:
    counted = alerts.groupBy(F.window("event_time", bucket), "kind").agg(F.count("*").alias("total"))
    return counted.select((F.unix_timestamp("window.start") * 1000).alias("time"), "kind", "total")


TOTALS = "protocol string, packets bigint, bytes bigint"


def running_totals(packets: DataFrame) -> DataFrame:
    """Totals for a live view; use with the update or complete output mode."""
    return packets.groupBy("protocol").agg(F.count("*").alias("packets"), F.sum("length").cast("long").alias("bytes"))


def totals_sink(root: str):
    """``foreachBatch`` function for `running_totals` in update mode: the changed rows of a trigger replace those of their key in
    the table under ``root/totals``, which a live view reads as ``Kept(...).before(...)``."""

    def sink(batch: DataFrame, number: int) -> None:
        table = Kept(batch.sparkSession, f"{root}/totals", ["protocol"], TOTALS)
        table.compact(number)
        table.change(number, batch)

    return sink
