"""Entropy, sizes, previews and time text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _entropy_of(symbols: Column) -> Column:
    """Shannon entropy (bits per symbol) of an array: one pass over the sorted symbols.

    With run lengths c and n symbols, H = log2(n) - sum(c*log2(c))/n.
    """
    def clogc(count: Column) -> Column:
        return count * F.log2(count)

    zero = F.lit(0.0)
    start = F.struct(F.lit(None).cast("string").alias("last"), zero.alias("run"), zero.alias("acc"))

    def step(state: Column, symbol: Column) -> Column:
        same = state["last"].eqNullSafe(symbol)
        return F.struct(
            symbol.alias("last"),
            F.when(same, state["run"] + 1.0).otherwise(F.lit(1.0)).alias("run"),
            F.when(same | (state["run"] == 0.0), state["acc"])
            .otherwise(state["acc"] + clogc(state["run"])).alias("acc"),
        )

    def finish(state: Column) -> Column:
        n = F.size(symbols).cast("double")
        return F.log2(n) - (state["acc"] + clogc(state["run"])) / n

    return F.when(F.size(symbols) == 0, zero).otherwise(
        F.aggregate(F.sort_array(symbols), start, step, finish)
    )


def bytes_entropy(data: Column) -> Column:
    """Entropy of a binary column; empty → 0."""
    return _entropy_of(F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1)))


def label_entropy(text: Column) -> Column:
    """Entropy of the UTF-8 bytes of a text column."""
    return bytes_entropy(F.encode(text, "UTF-8"))


def human_bytes(n: Column) -> Column:
    """1024-based size: plain bytes without decimals, larger units with one."""
    value = n.cast("double")
    size = F.abs(value)
    text = F.when(size < 1024.0, F.format_string("%.0fB", value))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), start=1):
        text = text.when(
            size < 1024.0 ** (power + 1), F.format_string(f"%.1f{unit}", value / 1024.0**power)
        )
    return text.otherwise(F.format_string("%.1fPB", value / 1024.0**5))


def human_rate(n: Column) -> Column:
    return F.concat(human_bytes(n), F.lit("/s"))


def printable(text: Column) -> Column:
    """Control and other non-printable characters become dots; space and tab stay."""
    return F.regexp_replace(text, r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^ \t]]", ".")


def payload_preview(data: Column, limit: int = 200) -> Column:
    """First bytes as UTF-8 text (bad sequences replaced), non-printable characters as dots."""
    return printable(F.call_function("make_valid_utf8", F.substring(data, 1, limit).cast("string")))


def latin1(data: Column) -> Column:
    """Bytes as text, one character per byte."""
    return F.decode(data, "ISO-8859-1")


def utc(stamp: Column) -> Column:
    """A timestamp that shows its UTC fields whatever the session's time zone."""
    return F.to_utc_timestamp(stamp, F.current_timezone())


def clock_text(ts: Column) -> Column:
    """Epoch seconds → ``HH:MM:SS.mmm`` (milliseconds cut, not rounded)."""
    millis = F.floor(ts * 1000).cast("long")
    return F.date_format(utc(F.timestamp_millis(millis)), "HH:mm:ss.SSS")


def iso_time(ts: Column) -> Column:
    """Epoch seconds → ISO-8601 in UTC; microseconds shown only when present."""
    micros = F.round(ts * 1000000).cast("long")
    stamp = utc(F.timestamp_micros(micros))
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(
        whole, F.when(micros % 1000000 != 0, F.date_format(stamp, ".SSSSSS")).otherwise(F.lit("")), F.lit("Z")
    )


def bucket_millis(ts: Column, seconds: int = 300) -> Column:
    """Start of the tumbling bucket in epoch milliseconds."""
    return (F.floor(ts / seconds) * (seconds * 1000)).cast("long")


def first_line(text: Column, limit: int = 70) -> Column:
    return F.substring(F.split(text, r"\r\n|[\n\r]")[0], 1, limit)
