"""Packet predicates as boolean columns to combine with ``&``, ``|`` and ``~``.

Every predicate is two-valued: a missing layer or address gives false, never null, so
``~host(...)`` keeps rows without an address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import has_flag
from ..functions.net import in_net
from ..functions.text import latin1

_OPERATORS = {
    ">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__,
    "=": Column.__eq__, "==": Column.__eq__, "!=": Column.__ne__,
}


def _total(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _ends(direction: str | None, src: str, dst: str) -> list[Column]:
    if direction is None:
        return [F.col(src), F.col(dst)]
    return [F.col({"src": src, "dst": dst}[direction])]


def _any(conditions: list[Column]) -> Column:
    out = _total(conditions[0])
    for condition in conditions[1:]:
        out = out | _total(condition)
    return out


def everything() -> Column:
    """The empty filter."""
    return F.lit(True)


def proto(name: str) -> Column:
    """A layer is present: tcp, udp, icmp, arp, dns, http, ip4 (or ip), ip6; anything else is false."""
    name = name.lower()
    if name in ("tcp", "udp", "icmp"):
        return _total(F.col("transport") == name.upper())
    if name in ("ip", "ip4"):
        return _total(F.col("ip_version") == 4)
    if name == "ip6":
        return _total(F.col("ip_version") == 6)
    if name in ("arp", "dns", "http"):
        return F.col(name).isNotNull()
    raise ValueError(f"unknown protocol {name!r}")


def host(address: str, direction: str | None = None) -> Column:
    return _any([end == address for end in _ends(direction, "src_ip", "dst_ip")])


def net(cidr: str, direction: str | None = None) -> Column:
    return _any([in_net(end, cidr) for end in _ends(direction, "src_ip", "dst_ip")])


def port(number: int, direction: str | None = None) -> Column:
    return _any([end == number for end in _ends(direction, "src_port", "dst_port")])


def portrange(low: int, high: int) -> Column:
    return _any([end.between(low, high) for end in _ends(None, "src_port", "dst_port")])


def length(op: str, number: int) -> Column:
    """Compare the length on the wire."""
    if op not in _OPERATORS:
        raise ValueError(f"unsupported comparison {op!r}")
    return _total(_OPERATORS[op](F.col("length"), F.lit(number)))


def tcp_flag(name: str) -> Column:
    return has_flag(F.col("tcp_flags"), name)


def payload_contains(needle: str) -> Column:
    """Case-insensitive for ASCII letters; the needle is lower-cased as text and matched as UTF-8 bytes."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    wanted = needle.lower().encode("utf-8", "replace").decode("latin-1")
    text = F.translate(latin1(F.coalesce("payload", F.lit(b""))), upper, lower)
    return _total(text.contains(F.lit(wanted)))


def since(seconds: float, as_of: Column | float, ts: str = "ts") -> Column:
    """Rows of the trailing window that ends at ``as_of`` (closed start, no upper bound)."""
    return F.col(ts) >= (F.lit(as_of) if not isinstance(as_of, Column) else as_of) - F.lit(float(seconds))


def first_seconds(df: DataFrame, seconds: float, ts: str = "ts") -> DataFrame:
    """The first T seconds of a capture."""
    start = df.agg(F.min(ts).alias("t0")).scalar()
    return df.filter(F.col(ts) < start + F.lit(float(seconds)))


def not_whitelisted(df: DataFrame, whitelist: DataFrame | list[str], ip: str = "src_ip") -> DataFrame:
    """Drop rows without an address and rows whose address is listed."""
    present = df.filter(F.col(ip).isNotNull())
    if isinstance(whitelist, list):
        return present.filter(~F.col(ip).isin(whitelist)) if whitelist else present
    return present.join(whitelist.select(F.col("ip").alias(ip)), ip, "left_anti")
