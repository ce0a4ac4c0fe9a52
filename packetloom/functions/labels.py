"""Names and derived text for protocol fields."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# IP protocol numbers.
IP_PROTOCOLS = {
    1: "ICMP", 2: "IGMP", 6: "TCP", 17: "UDP", 41: "IPv6", 47: "GRE", 50: "ESP", 51: "AH",
    58: "ICMPv6", 89: "OSPF", 132: "SCTP",
}
# TCP flag bits, lowest first.
TCP_FLAGS = {
    "FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32, "ECE": 64, "CWR": 128,
}
# ICMP types.
ICMP_TYPES = {
    0: "echo-reply", 3: "dest-unreachable", 4: "source-quench", 5: "redirect", 8: "echo-request",
    9: "router-advertisement", 10: "router-solicitation", 11: "time-exceeded",
    12: "parameter-problem", 13: "timestamp", 14: "timestamp-reply", 128: "echo-request-v6",
    129: "echo-reply-v6",
}
# ARP operations.
ARP_OPERATIONS = {1: "request", 2: "reply"}
# DNS record types and response codes.
DNS_TYPES = {
    1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 10: "NULL", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA",
    33: "SRV", 35: "NAPTR", 41: "OPT", 43: "DS", 48: "DNSKEY", 252: "AXFR", 255: "ANY",
}
DNS_RCODES = {0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED"}


def lookup(code: Column, table: Mapping) -> Column:
    """Look a code up in a small literal table; null when absent."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.element_at(F.create_map(*entries), code)


def ip_protocol_name(code: Column) -> Column:
    return F.coalesce(lookup(code, IP_PROTOCOLS), F.concat(F.lit("IP-"), code.cast("string")))


def monitor_protocol_name(code: Column) -> Column:
    """The flat table's shorter list: three names, any other number as text."""
    short = {n: IP_PROTOCOLS[n] for n in (1, 6, 17)}
    return F.coalesce(lookup(code, short), code.cast("string"))


def flag_text(flags: Column, names=tuple(TCP_FLAGS)) -> Column:
    """Flag byte → ``SYN|ACK`` (low bit first), ``NONE`` when no listed bit is set."""
    parts = [F.when(flags.bitwiseAND(F.lit(TCP_FLAGS[n])) != 0, F.lit(n)) for n in names]
    text = F.concat_ws("|", *parts)
    return F.when(flags.isNotNull(), F.when(text == "", F.lit("NONE")).otherwise(text))


def monitor_flag_text(flags: Column) -> Column:
    """The flat table keeps the six classic flags only."""
    return flag_text(flags, ("FIN", "SYN", "RST", "PSH", "ACK", "URG"))


def has_flag(flags: Column, name: str) -> Column:
    bit = TCP_FLAGS.get(name.upper())
    if bit is None:
        return F.lit(False)
    return F.coalesce(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(False))


def scan_signature(flags: Column) -> Column:
    """Name of a stealth-scan flag combination over the six classic bits; null for normal flags."""
    low = flags.bitwiseAND(F.lit(63))
    return (
        F.when(low == 0, F.lit("NULL scan"))
        .when(low == 1, F.lit("FIN scan"))
        .when(low == 41, F.lit("XMAS scan"))
        .when(low.bitwiseAND(F.lit(3)) == 3, F.lit("SYN+FIN scan"))
        .when(low.isin(32, 33), F.lit("URG probe"))
    )


def syn_only_text(flags: Column) -> Column:
    """Flag text shows SYN but not ACK."""
    return F.coalesce(flags.contains("SYN") & ~flags.contains("ACK"), F.lit(False))


def icmp_type_name(code: Column) -> Column:
    return F.coalesce(lookup(code, ICMP_TYPES), F.concat(F.lit("type-"), code.cast("string")))


def arp_operation_name(code: Column) -> Column:
    return F.coalesce(lookup(code, ARP_OPERATIONS), code.cast("string"))


def dns_type_name(code: Column) -> Column:
    return F.coalesce(lookup(code, DNS_TYPES), code.cast("string"))


def dns_rcode_name(code: Column) -> Column:
    return F.coalesce(lookup(code, DNS_RCODES), code.cast("string"))


def hex4(number: Column) -> Column:
    """``0x0800`` form of a 16-bit number."""
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(number), 4, "0")))


def dont_fragment(ip_flags: Column) -> Column:
    return ip_flags.bitwiseAND(F.lit(2)) != 0


def more_fragments(ip_flags: Column) -> Column:
    return ip_flags.bitwiseAND(F.lit(1)) != 0
