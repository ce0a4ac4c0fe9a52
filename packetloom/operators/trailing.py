"""Counts, sums and distinct values over a trailing time range, per key.

The frame of a row is everything with the same key in ``[ts - span, ts]`` (equal times
included).  Instead of re-reading the frame for every row, each value adds at its time and
subtracts when it leaves, and a running sum gives the answer: linear in the rows, whatever
the rate.  Time is cut into slices of a few spans; a row that still counts in the next slice
is copied there, so a hot key spreads over many tasks and the result stays exact.

A row is dealt once, by key and slice; there the rows of one instant are combined and everything else is computed.  A stream
combines them in windows that close when the watermark passes; from there on both share `answers`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import deal

SLICE_SPANS = 4


def instants(df: DataFrame, keys: list[str], value: str | None, amount: Column | None, ts: str = "ts", seq: str = "pkt_id", more: tuple = ()) -> DataFrame:
    """(more, keys, [value,] ts, seq, [__amount]): one row per key, value and instant with the lowest ``seq``."""
    by = [*more, *keys, *([value] if value else []), ts]
    sums = [] if value else [F.sum(amount).cast("long").alias("__amount")]
    return df.groupBy(*by).agg(F.min(seq).alias(seq), *sums)


def slice_length(span: float, slice_seconds: float | None = None) -> float:
    length = float(slice_seconds or span * SLICE_SPANS)
    if length < span:
        raise ValueError("a slice must be at least one span long")
    return length


def _dealt(df: DataFrame, keys: list[str], value: str | None, amount: Column | None, span: float, ts: str, seq: str, slice_seconds: float | None) -> DataFrame:
    """`instants` of every slice, dealt by key and slice, in one shuffle."""
    length = slice_length(span, slice_seconds)
    home = F.floor(F.col(ts) / length)
    # A hair longer than the span: a copy too many is harmless, rounding must not lose one.
    leaves = F.floor((F.col(ts) + F.lit(span + 1e-3)) / length)
    thin = df.select(*dict.fromkeys([*keys, *([value] if value else []), ts, seq]), *([] if value else [amount.alias("__amount")]),
                     home.alias("__home"), F.explode(F.sequence(home, leaves)).alias("__slice"))
    amount = None if value else F.col("__amount")
    return instants(deal(thin, *keys, "__slice"), keys, value, amount, ts, seq, more=("__home", "__slice"))


def _events(df: DataFrame, ts: str, span: float, arriving: Column, leaving: Column) -> DataFrame:
    """One row per arrival and one per departure, on the axis ``ts - span``.

    A value from t counts for a row at ts while ``t >= ts - span``.  With arrivals placed at
    ``ts - span`` and departures at t, that comparison decides the order, so edges come out
    as written whatever the rounding.
    """
    arrival = F.struct(
        (F.col(ts) - F.lit(float(span))).alias("at"), F.lit(0).alias("kind"), F.col(ts).alias("tie"), arriving.alias("delta"))
    departure = F.struct(
        F.col(ts).alias("at"), F.lit(1).alias("kind"), F.lit(0.0).alias("tie"), leaving.alias("delta"))
    exploded = df.withColumn("__event", F.explode(F.array(arrival, departure)))
    return exploded.filter((F.col("__event.kind") == 0) | (F.col("__event.delta") != 0))


def _answers(events: DataFrame, keys: list[str], out: str) -> DataFrame:
    running = Window.partitionBy(*keys, "__slice").orderBy(
        "__event.at", "__event.kind", "__event.tie"
    ).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        events.withColumn(out, F.sum("__event.delta").over(running))
        .filter((F.col("__event.kind") == 0) & (F.col("__slice") == F.col("__home")))
        .drop("__event", "__slice", "__home")
    )


def answers(sliced: DataFrame, keys: list[str], value: str | None, span: float, out: str, ts: str = "ts") -> DataFrame:
    """(keys, [value,] ts, seq, out) from `instants` that know their ``__home``, stand in every ``__slice`` they count in and
    are dealt by key and slice.

    Occurrences of one value closer than ``span`` form one presence: it opens at the first
    and closes a span after the last.
    """
    if not value:
        events = _events(sliced, ts, span, F.col("__amount"), -F.col("__amount"))
        return _answers(events, keys, out).drop("__amount")
    per_value = Window.partitionBy(*keys, "__slice", value).orderBy(ts)
    before, after = F.lag(ts).over(per_value), F.lead(ts).over(per_value)
    reach = F.lit(float(span))
    marked = sliced.withColumn(
        "__opens", (before.isNull() | (before < F.col(ts) - reach)).cast("long")
    ).withColumn("__closes", (after.isNull() | (F.col(ts) < after - reach)).cast("long"))
    events = _events(marked, ts, span, F.col("__opens"), -F.col("__closes"))
    return _answers(events, keys, out).drop("__opens", "__closes")


def trailing_sum(
    df: DataFrame, keys: list[str], span: float, amount: Column, out: str = "total",
    ts: str = "ts", seq: str = "pkt_id", slice_seconds: float | None = None,
) -> DataFrame:
    """(keys, ts, seq, out): the sum over the frame, one row per key and instant."""
    return answers(_dealt(df, keys, None, amount, span, ts, seq, slice_seconds), keys, None, span, out, ts)


def trailing_count(df: DataFrame, keys: list[str], span: float, out: str = "n", **options) -> DataFrame:
    """(keys, ts, seq, out): rows in the frame, one row per key and instant."""
    return trailing_sum(df, keys, span, F.lit(1), out, **options)


def trailing_distinct(
    df: DataFrame, keys: list[str], value: str, span: float, out: str = "n",
    ts: str = "ts", seq: str = "pkt_id", slice_seconds: float | None = None,
) -> DataFrame:
    """(keys, value, ts, seq, out): distinct values in the frame, one row per key, value and instant."""
    return answers(_dealt(df, keys, value, None, span, ts, seq, slice_seconds), keys, value, span, out, ts)
