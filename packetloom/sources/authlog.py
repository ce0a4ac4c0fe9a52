"""sshd log lines → login events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Line patterns (user, address, port groups by position; 0 = not in the line).
ACCEPTED = (r"Accepted (?:password|publickey) for (\S+) from ([0-9a-fA-F:.]+) port (\d+)", 1, 2, 3)
FAILURES = (
    (r"Failed password for (?:invalid user )?(\S+) from ([0-9a-fA-F:.]+) port (\d+)", 1, 2, 3),
    (r"Invalid user (\S+) from ([0-9a-fA-F:.]+)", 1, 2, 0),
    (r"authentication failure;.*rhost=([0-9a-fA-F:.]+)(?:\s+user=(\S+))?", 2, 1, 0),
)


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``src_ip, username, service, port, success``; lines that match nothing are dropped.

    The accept pattern is tried first, then the failure patterns in order.
    """
    def number(text: Column) -> Column:
        """The port as written, 22 where the line has none, null where it is no number a long can hold."""
        return F.when(text == "", F.lit(22).cast("bigint")).otherwise(text.try_cast("bigint"))

    def event(pattern, success: bool) -> Column:
        regex, user, ip, port = pattern
        def group(i):
            return F.regexp_extract(line, regex, i) if i else F.lit("")
        return F.struct(
            group(ip).alias("src_ip"), F.coalesce(F.nullif(group(user), F.lit("")), F.lit("unknown")).alias("username"),
            F.lit("sshd").alias("service"), number(group(port)).alias("port"),
            F.lit(success).alias("success"),
        )

    chain = F.when(F.col(line).rlike(ACCEPTED[0]), event(ACCEPTED, True))
    for pattern in FAILURES:
        chain = chain.when(F.col(line).rlike(pattern[0]), event(pattern, False))
    parsed = lines.withColumn("__event", chain).filter(F.col("__event").isNotNull())
    return parsed.select(*[c for c in lines.columns if c != line], "__event.*")


def read(spark: SparkSession, path: str, ts: Column) -> DataFrame:
    """Read log files; ``ts`` says how to get the event time (a column over ``value`` or metadata)."""
    return parse_lines(spark.read.text(path).select(ts.alias("ts"), F.col("value").alias("line")))


def stream(spark: SparkSession, path: str, ts: Column) -> DataFrame:
    """Follow the log files of a pattern (``file:///var/log/auth.log*``) while they grow and are rotated; ``ts`` is a column over
    ``line``, ``log`` and ``offset``."""
    from .tail import LogTail

    spark.dataSource.register(LogTail)
    lines = spark.readStream.format("log_tail").option("path", path).load()
    return parse_lines(lines.select(ts.alias("ts"), "log", "offset", "line"))
