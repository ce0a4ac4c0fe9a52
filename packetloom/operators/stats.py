"""Traffic statistics.  Grouped counts combine on the map side; top lists keep first-seen order on ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import dns_type_name, flag_text, hex4, icmp_type_name


def totals(packets: DataFrame, matched: Column | None = None) -> DataFrame:
    """Packets, bytes, average size, rows with decode errors, rows filtered out, duration."""
    keep = F.lit(True) if matched is None else matched
    has_errors = F.size("errors") > 0 if "errors" in packets.columns else F.lit(False)
    bytes_ = F.coalesce(F.sum(F.when(keep, F.col("length"))), F.lit(0)).cast("long")
    count = F.count_if(keep)
    return packets.agg(
        count.alias("packets"),
        bytes_.alias("bytes"),
        F.coalesce(F.try_divide(bytes_, count), F.lit(0.0)).alias("average_size"),
        F.count_if(keep & has_errors).alias("decode_errors"),
        F.count_if(~keep).alias("filtered_out"),
        (F.max(F.when(keep, F.col("ts"))) - F.min(F.when(keep, F.col("ts")))).alias("duration"),
    )


def _counted(df: DataFrame, key: Column, name: str, value: Column, out: str, seq: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(value.alias(out), F.min(seq).alias("first_seen"))


def top(counted: DataFrame, value: str, n: int) -> DataFrame:
    """The n largest; equal values keep the order in which they were first seen."""
    return counted.orderBy(F.desc(value), F.asc("first_seen")).limit(n)


def by_protocol(packets: DataFrame, seq: str = "pkt_id") -> DataFrame:
    """Packets per protocol label and their share; the total is taken over the few label rows."""
    counted = _counted(packets, F.col("protocol"), "protocol", F.count("*"), "packets", seq)
    return counted.withColumn("share", F.col("packets") / F.sum("packets").over(Window.partitionBy(F.lit(0))))


def by_ethertype(packets: DataFrame, seq: str = "pkt_id") -> DataFrame:
    rows = packets.filter(F.col("ethertype").isNotNull())
    return _counted(rows, hex4(F.col("ethertype")), "ethertype", F.count("*"), "packets", seq)


def by_talker(packets: DataFrame, seq: str = "pkt_id") -> DataFrame:
    rows = packets.filter(F.col("src_ip") != "")
    return _counted(rows, F.col("src_ip"), "src_ip", F.sum("length").cast("long"), "bytes", seq)


def by_conversation(packets: DataFrame, seq: str = "pkt_id") -> DataFrame:
    """Bytes per undirected pair, the smaller text first."""
    rows = packets.filter((F.col("src_ip") != "") & (F.col("dst_ip") != ""))
    pair = F.concat_ws(" <-> ", F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip"))
    return _counted(rows, pair, "conversation", F.sum("length").cast("long"), "bytes", seq)


def by_destination_port(packets: DataFrame, seq: str = "pkt_id") -> DataFrame:
    rows = packets.filter(F.col("dst_port").isNotNull())
    key = F.concat_ws("/", F.coalesce("transport", F.lit("?")), F.col("dst_port").cast("string"))
    return _counted(rows, key, "port", F.count("*"), "packets", seq)


def by_flags(packets: DataFrame, seq: str = "pkt_id") -> DataFrame:
    rows = packets.filter(F.col("tcp_flags").isNotNull())
    grouped = rows.groupBy("tcp_flags").agg(F.count("*").alias("packets"), F.min(seq).alias("first_seen"))
    return grouped.select(flag_text(F.col("tcp_flags")).alias("flags"), "packets", "first_seen")


def by_icmp_type(packets: DataFrame, seq: str = "pkt_id") -> DataFrame:
    rows = packets.filter(F.col("icmp_type").isNotNull())
    return _counted(rows, icmp_type_name(F.col("icmp_type")), "icmp_type", F.count("*"), "packets", seq)


def by_dns_query(first_questions: DataFrame, seq: str = "pkt_id") -> DataFrame:
    """``TYPE name`` of the first question of each query packet."""
    key = F.concat_ws(" ", dns_type_name(F.col("qtype")), F.col("qname"))
    return _counted(first_questions, key, "query", F.count("*"), "packets", seq)


def by_http_host(packets: DataFrame, seq: str = "pkt_id") -> DataFrame:
    rows = packets.filter((F.col("http.kind") == "request") & (F.col("http.headers")["host"] != ""))
    return _counted(rows, F.col("http.headers")["host"], "host", F.count("*"), "packets", seq)


def by_http_method(packets: DataFrame, seq: str = "pkt_id") -> DataFrame:
    rows = packets.filter(F.col("http.kind") == "request")
    return _counted(rows, F.coalesce("http.method", F.lit("?")), "method", F.count("*"), "packets", seq)


def rate(packets: DataFrame, window: float = 10.0) -> DataFrame:
    """Packets and bytes per second over the trailing window that ends at the last packet."""
    last = packets.agg(F.max("ts")).scalar()
    recent = packets.filter(F.col("ts") >= last - F.lit(float(window)))
    n, span = F.count("*"), F.max("ts") - F.min("ts")
    usable = (n >= 2) & (span > 0)
    return recent.agg(
        F.when(usable, n / span).otherwise(0.0).alias("packets_per_second"),
        F.when(usable, F.sum("length") / span).otherwise(0.0).alias("bytes_per_second"),
    )


def packet_limit(packets: DataFrame, n: int, seq: str = "pkt_id") -> DataFrame:
    """Stop after n matching packets (in capture order)."""
    return packets.orderBy("ts", seq).limit(n)
