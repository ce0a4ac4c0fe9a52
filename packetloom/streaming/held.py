"""Rules over streams that do not depend on how the rows arrive.

Rows are held back in the state of a windowed aggregation until the watermark has passed their slice of time; so late and
shuffled rows take their place, and the batch operators see whole slices.  The aggregation is Spark's own: its state has
one row for each key, (value) and instant, dealt by all of them, so no key is one list or one task.  What comes out in
slices of time is handled by `alert_sink`, which computes the trailing measure with the batch operators and follows
the cooldown on from the alerts that earlier batches stored.

Rows that come later than the watermark allows are dropped.  The alerts of a slice come out when the watermark has passed
the slice's end.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cooldown import cooldown
from ..operators.rules import Trailing
from ..operators.trailing import answers, instants, slice_length
from ..session import materialize, scratch
from .store import put, recent


def _ms(seconds: float) -> str:
    return f"{round(seconds * 1000)} milliseconds"


def _micros(ts: str):
    return F.unix_micros(F.timestamp_seconds(ts))


def whole_slices(stream: DataFrame, rule: Trailing, slice_seconds: float | None = None, ts: str = "ts", seq: str = "pkt_id") -> DataFrame:
    """The instants of finished slices, each with the span before it; needs a watermark on ``event_time``."""
    length = slice_length(rule.span, slice_seconds)
    if length <= rule.span:
        raise ValueError("in a stream a slice must be longer than the span")
    lead = rule.span + 1e-3  # a hair longer: rounding must not lose a row
    slices = F.window("event_time", _ms(length + lead), _ms(length), _ms(length - lead))
    amount = F.col(rule.amount) if rule.amount else F.lit(1)
    grouped = instants(rule.rows(stream).withColumn("__window", slices), list(rule.keys), rule.value, amount, ts, seq, more=("__window",))
    home = F.floor(_micros(ts) / round(length * 1e6))
    number = F.floor((F.unix_micros("__window.end") - 1) / round(length * 1e6))
    return grouped.withColumn("__home", home).withColumn("__slice", number).drop("__window")


def held_rows(stream: DataFrame, seconds: float = 10.0) -> DataFrame:
    """The distinct rows of a stream, let out when the watermark has passed their ``seconds``."""
    columns = [c for c in stream.columns if c != "event_time"]
    return stream.groupBy(F.window("event_time", _ms(seconds)), *columns).agg(F.count("*").alias("__copies")).select(*columns)


@contextlib.contextmanager
def _adaptive(spark: SparkSession):
    """Adaptive execution, as the application has it, for steps over stored rows of a micro-batch: Spark turns it off in streams
    with state, so every step would run as many tasks as the state has parts, most of them over a few rows."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, spark.sparkContext.getConf().get(name, "true"))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def follow_cooldown(hits: DataFrame, keys: list[str], quiet: float, root: str, batch: int, ts: str = "ts", seq: str = "pkt_id") -> DataFrame:
    """Which hits of a batch fire, given what fired in earlier batches; stored under ``root``.

    Earlier alerts begin the chains: a hit within ``quiet`` of one does not fire.  Only alerts of the last ``quiet`` seconds
    before the batch are read.
    """
    spark = hits.sparkSession
    new = materialize(hits)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema)
    with _adaptive(spark):
        ends = new.agg(F.min(ts), F.max(ts)).first()
        if ends[0] is None:
            return spark.createDataFrame([], schema)
        old = recent(spark, root, "fired", schema, ends[0] - quiet, ends[1], batch, ts).select(*hits.columns, F.lit(False).alias("__new"))
        fired = cooldown(new.withColumn("__new", F.lit(True)).unionByName(old), keys, quiet, ts, seq)
        put(fired.filter("__new").drop("__new"), root, "fired", batch, ts, tuple(ends))
        return recent(spark, root, "fired", schema, ends[0], ends[1], batch + 1, ts).filter(F.col("batch") == batch).select(*hits.columns)


def alert_sink(root: str, rule: Trailing, quiet: float, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function over `whole_slices`: alerts go to ``root/alerts``, by time and batch."""

    def sink(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            rows = materialize(batch)
            if rows.isEmpty():
                return
            hits = answers(rows.repartition(*rule.keys, "__slice"), list(rule.keys), rule.value, rule.span, rule.out, ts).filter(F.col(rule.out) >= rule.least)
            names = [*rule.keys, ts, "pkt_id", rule.out]
            fired = follow_cooldown(hits.select(*names), list(rule.keys), quiet, root, number, ts)
            if not fired.isEmpty():
                put(rule.alerts(fired, rows), root, "alerts", number, ts)

    return sink


def cooldown_sink(root: str, keys: list[str], quiet: float, ts: str = "ts", seq: str = "pkt_id") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function over `held_rows`: rows that fire go to ``root/fired``."""

    def sink(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            follow_cooldown(batch, keys, quiet, root, number, ts, seq)

    return sink
