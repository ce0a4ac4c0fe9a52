"""Report and dashboard queries over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bucket_millis, utc


def _at(as_of: Column | float) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(float(as_of))


def _since(df: DataFrame, as_of: Column | float, seconds: float) -> DataFrame:
    return df.filter(F.col("ts") >= _at(as_of) - F.lit(float(seconds)))


def alerts_by_kind_severity(alerts: DataFrame, as_of: Column | float, hours: float = 24) -> DataFrame:
    counted = _since(alerts, as_of, hours * 3600).groupBy("kind", "severity").agg(F.count("*").alias("total"))
    return counted.orderBy(F.desc("total"), "kind", "severity")


def alerts_by_kind(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("kind").agg(F.count("*").alias("total"))


def alerts_per_bucket(alerts: DataFrame, seconds: int = 300) -> DataFrame:
    """Alerts per tumbling bucket (start in epoch milliseconds) and kind."""
    counted = alerts.groupBy(bucket_millis(F.col("ts"), seconds).alias("time"), "kind").agg(F.count("*").alias("total"))
    return counted.orderBy("time", "kind")


def alert_count(alerts: DataFrame, as_of: Column | float, hours: float = 24) -> DataFrame:
    return _since(alerts, as_of, hours * 3600).agg(F.count("*").alias("alerts"))


def reputation_counts(reputation: DataFrame, threshold: int = 50) -> DataFrame:
    """Suspicious and blocklisted addresses in one pass."""
    return reputation.agg(F.count_if(F.col("score") >= threshold).alias("suspicious"),
                          F.count_if("blocklisted").alias("blocklisted"))


def blocklist_size(blocklist: DataFrame) -> DataFrame:
    return blocklist.agg(F.count("*").alias("entries"))


def failed_logins(auth_events: DataFrame, as_of: Column | float, hours: float = 1) -> DataFrame:
    return _since(auth_events.filter(~F.col("success")), as_of, hours * 3600).agg(F.count("*").alias("failures"))


def volume_series(windows: DataFrame, edge: str = "window_start") -> DataFrame:
    """Packets and sources per stored window over time; keyed by the start or the end of the window."""
    return windows.select(
        (F.floor(edge) * 1000).cast("long").alias("time"), F.col("packet_count").alias("packets"),
        F.col("unique_sources").alias("sources"),
    ).orderBy("time")


def recent_alerts(alerts: DataFrame, n: int = 50) -> DataFrame:
    stamp = F.date_format(utc(F.timestamp_seconds("ts")), "yyyy-MM-dd HH:mm:ss").alias("time")
    newest = alerts.orderBy(F.desc("ts"), F.desc("id")).limit(n)
    return newest.select(stamp, "severity", "kind", "src_ip", "title", "detail")
