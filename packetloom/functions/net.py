"""Addresses: sortable keys, CIDR membership, private ranges, host and domain helpers.

An address is turned once into a fixed-width hexadecimal key (``4:0a000001`` or
``6:20010db8…``).  A CIDR literal becomes a key range, so membership is a plain
``BETWEEN`` that Parquet statistics can prune when the key is stored as a column.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Networks treated as internal, and the multicast ranges.
INTERNAL_NETWORKS = (
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10", "169.254.0.0/16",
    "127.0.0.0/8", "fc00::/7", "fe80::/10", "::1/128",
)
MULTICAST_NETWORKS = ("224.0.0.0/4", "ff00::/8")

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_HEX_GROUPS = r"^[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*$"


def _total(condition: Column) -> Column:
    """Two-valued form of a condition: unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def _let(value: Column, use) -> Column:
    """Evaluate ``value`` once and use it in several places of an expression."""
    return F.transform(F.array(value), use)[0]


def ipv4_number(ip: Column) -> Column:
    """Dotted address → unsigned 32-bit number as long; null when it is not IPv4."""
    def number(part: Column) -> Column:
        return sum((part[i].cast("long") * (256 ** (3 - i)) for i in range(1, 4)), part[0].cast("long") * 256**3)

    return F.when(ip.rlike(_IPV4), _let(F.split(ip, r"\."), number))


def ipv4_text(number: Column) -> Column:
    """Unsigned 32-bit number → dotted address."""
    return F.concat_ws(
        ".",
        *[F.shiftright(number, 8 * (3 - i)).bitwiseAND(F.lit(255)).cast("string") for i in range(4)],
    )


def _v4_hex(ip: Column) -> Column:
    """Eight hexadecimal digits of a dotted address, else null."""
    return F.lower(F.lpad(F.hex(ipv4_number(ip)), 8, "0"))


def _v6_hex(ip: Column) -> Column:
    """32 hexadecimal digits of an IPv6 text (embedded IPv4 and zone suffix allowed), else null."""
    text = F.lower(F.regexp_replace(ip, r"%[^%/]+$", ""))

    def spelled_out(t: Column) -> Column:
        tail = F.regexp_extract(t, r":([0-9]+(?:\.[0-9]+){3})$", 1)
        rewritten = _let(_v4_hex(tail), lambda h: F.concat(
            F.regexp_replace(t, r"[0-9]+(?:\.[0-9]+){3}$", ""), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4)))
        return F.when(t.contains("."), rewritten).otherwise(t)

    def padded(groups: Column) -> Column:
        return F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")

    def joined(halves: Column) -> Column:
        groups = F.transform(halves, lambda h: F.filter(F.split(h, ":"), lambda g: g != ""))
        well_formed = F.forall(halves, lambda h: (h == "") | h.rlike(_HEX_GROUPS))

        def build(g: Column) -> Column:
            left, right = g[0], F.coalesce(F.get(g, F.lit(1)), F.array().cast("array<string>"))
            count = F.size(left) + F.size(right)
            right_size = F.when(F.size(halves) == 2, count <= 7).otherwise((F.size(halves) == 1) & (count == 8))
            return F.when(right_size, F.concat(padded(left), F.repeat(F.lit("0000"), 8 - count), padded(right)))

        return F.when(well_formed, _let(groups, build))

    return F.when(ip.contains(":"), _let(spelled_out(text), lambda t: _let(F.split(t, "::"), joined)))


def ip_key(ip: Column) -> Column:
    """Sortable key of a v4 or v6 address; null when the text is not an address."""
    return F.when(ip.contains(":"), F.concat(F.lit("6:"), _v6_hex(ip))).otherwise(
        F.concat(F.lit("4:"), _v4_hex(ip))
    )


def cidr_range(cidr: str) -> tuple[str, str] | None:
    """Key range of a CIDR literal (host bits allowed); ``None`` when it is malformed."""
    try:
        network = ipaddress.ip_network(cidr, strict=False)
    except ValueError:
        return None
    width = 8 if network.version == 4 else 32
    low, high = int(network.network_address), int(network.broadcast_address)
    return f"{network.version}:{low:0{width}x}", f"{network.version}:{high:0{width}x}"


def key_in_net(key: Column, cidr: str) -> Column:
    """Membership on a stored key column: a range test that Parquet statistics can prune."""
    bounds = cidr_range(cidr)
    return F.lit(False) if bounds is None else key.isNotNull() & key.between(*bounds)


def _pieces(low: str, high: str) -> list[str]:
    pieces: list[str] = []
    if isinstance(low, str) and isinstance(high, str) and low[:2] == high[:2]:
        head, width = low[:2], len(low) - 2
        at, end = int(low[2:], 16), int(high[2:], 16)
        while at <= end:
            digits = 0
            while digits < width and at % 16 ** (digits + 1) == 0 and at + 16 ** (digits + 1) - 1 <= end:
                digits += 1
            pieces.append(head + f"{at:0{width}x}"[:width - digits])
            at += 16**digits
    return pieces


def range_pieces(low: Column | str, high: Column | str) -> Column:
    """The fewest key prefixes that together hold exactly the keys from ``low`` to ``high`` (of one version)."""
    @F.pandas_udf("array<string>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_pieces(x, y) for x, y in zip(a, b)])

    return run(low, high)


def _v4_pattern(network: ipaddress.IPv4Network) -> str:
    """Regular expression of the dotted addresses inside a network."""
    octets = str(network.network_address).split(".")
    whole, bits = divmod(network.prefixlen, 8)
    parts = octets[:whole]
    if bits:
        first = int(octets[whole])
        parts.append("(?:" + "|".join(str(n) for n in range(first, first + 2 ** (8 - bits))) + ")")
    parts += [_OCTET] * (4 - len(parts))
    return r"\.".join(parts)


def _in_any(ip: Column, cidrs) -> Column:
    """Membership in any of the networks: one compiled pattern for IPv4, key ranges for IPv6."""
    networks = [ipaddress.ip_network(c, strict=False) for c in cidrs]
    v4 = [_v4_pattern(n) for n in networks if n.version == 4]
    v6 = [(int(n.network_address), int(n.broadcast_address)) for n in networks if n.version == 6]

    def within(key: Column) -> Column:
        out = F.lit(False)
        for low, high in v6:
            out = out | key.between(f"{low:032x}", f"{high:032x}")
        return out

    four = ip.rlike("^(?:" + "|".join(v4) + ")$") if v4 else F.lit(False)
    six = _let(_v6_hex(ip), within) if v6 else F.lit(False)
    return _total(F.when(ip.contains(":"), six).otherwise(four))


def in_net(ip: Column, cidr: str) -> Column:
    """Is the address inside the network?  Bad address or bad network → false."""
    return F.lit(False) if cidr_range(cidr) is None else _in_any(ip, [cidr])


def is_private(ip: Column) -> Column:
    """Internal by the fixed list, or multicast."""
    return _in_any(ip, INTERNAL_NETWORKS + MULTICAST_NETWORKS)


def ipv4_prefix_key(number: Column, length: Column) -> Column:
    """The network number of an IPv4 address at a prefix length (0..32)."""
    shift = (F.lit(32) - length).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", number, shift), shift)


def base_domain(name: Column, levels: int = 2) -> Column:
    """The last ``levels`` non-empty labels, case kept."""
    labels = F.filter(F.split(name, r"\."), lambda label: label != "")
    return F.array_join(
        F.slice(labels, F.greatest(F.size(labels) - levels, F.lit(0)) + 1, F.lit(levels)), "."
    )


def mac_text(raw: Column) -> Column:
    """Bytes → ``aa:bb:cc…``."""
    return F.lower(F.rtrim(F.regexp_replace(F.hex(raw), "(..)", "$1:"), F.lit(":")))


def endpoint(ip: Column, mac: Column, port: Column) -> Column:
    """``address:port`` with the MAC and then ``?`` standing in for a missing address."""
    return F.concat_ws(":", F.coalesce(ip, mac, F.lit("?")), port.cast("string"))


def ipv6_text(raw: Column) -> Column:
    """16 bytes → shortest text form (longest zero run folded, embedded IPv4 shown dotted)."""
    hexed = F.lower(F.hex(raw))
    parted = F.regexp_replace(hexed, "(.{4})(?=.)", "$1:")
    plain = F.regexp_replace(parted, "(^|:)0{1,3}(?=[0-9a-f])", "$1")
    v4_tail = F.concat_ws(
        ".", *[F.conv(F.substring(hexed, 25 + 2 * i, 2), 16, 10) for i in range(4)]
    )

    def fold(text: Column) -> Column:
        folded = text
        # Longest run first; the leftmost of equal runs wins because replacement stops at one.
        for run in range(2, 9):
            zeros = ":".join(["0"] * run)
            pattern = rf"(?:^|:){zeros}(?:$|:)"
            folded = F.when(text.rlike(pattern), F.regexp_replace(text, rf"^(.*?)(?:^|:){zeros}(?:$|:)", "$1::")).otherwise(folded)
        return F.when(text.rlike(r"(?:^|:)0:0(?:$|:)"), folded).otherwise(text)

    folded = F.transform(F.array(plain), fold)[0]  # the text is made once
    mapped = F.substring(hexed, 1, 24) == "0" * 20 + "ffff"
    compat = (F.substring(hexed, 1, 24) == "0" * 24) & (F.substring(hexed, 25, 4) != "0000")
    return (
        F.when(mapped, F.concat(F.lit("::ffff:"), v4_tail))
        .when(compat, F.concat(F.lit("::"), v4_tail))
        .otherwise(folded)
    )
