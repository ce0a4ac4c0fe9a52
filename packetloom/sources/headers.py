"""The flat header columns of frames in one pass.

`decode` builds every layer as nested columns; most rules and statistics read a dozen flat ones.  Here one Arrow step reads
the fixed headers of a whole batch at computed offsets with NumPy - link header and VLAN tags, ARP, IPv4, IPv6 with its
extension headers, TCP, UDP, ICMP - and returns the columns asked for and no others.  The values are those of
``decode.flatten(decode.decode(frames, ("link", "network", "transport")))``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import layers
from .layers import Frames, places, texts

#: Every column that can be asked for, with its type.
COLUMNS = {
    "captured_length": "int", "ethertype": "int", "vlan": "int", "ip_version": "int", "ip_proto": "int", "src_ip": "string", "dst_ip": "string",
    "src_key": "string", "dst_key": "string", "transport": "string", "src_port": "int", "dst_port": "int", "tcp_flags": "int", "icmp_type": "int",
}


def _addresses(f: Frames, p: dict, four_at: int, six_at: int, arp_at: int, key: bool) -> pa.Array:
    """Texts or sortable keys of addresses."""
    four, six = ((lambda x: "4:" + x.hex()), (lambda x: "6:" + x.hex())) if key else (layers.ipv4_text, layers.ipv6_text)
    return texts(f, (p["four"], p["net"] + four_at, 4, four), (p["arp"], p["net"] + arp_at, 4, four), (p["six"], p["net"] + six_at, 16, six))


def flat(frames: DataFrame, columns: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """Frames (``raw, linktype`` and others) → their other columns and the header columns asked for."""
    kept = [x for x in frames.schema if x.name not in ("raw", "linktype", *columns)]
    schema = ", ".join([f"`{x.name}` {x.dataType.simpleString()}" for x in kept] + [f"{c} {COLUMNS[c]}" for c in columns])

    def column(name: str, f: Frames, p: dict) -> pa.Array:
        number = lambda values, ok: pa.array(values.astype(np.int32), mask=~ok)
        ported = p["tcp"] | p["udp"]
        if name == "captured_length":
            return pa.array(f.size.astype(np.int32))
        if name == "ethertype":
            return number(p["ethertype"], p["has_eth"])
        if name == "vlan":
            return number(f.short(14) & 4095, p["tags"] > 0)
        if name == "ip_version":
            return number(np.where(p["four"], 4, 6), p["four"] | p["six"])
        if name == "ip_proto":
            return number(p["proto"], p["four"] | p["six"])
        if name in ("src_ip", "src_key"):
            return _addresses(f, p, 12, 8, 14, name == "src_key")
        if name in ("dst_ip", "dst_key"):
            return _addresses(f, p, 16, 24, 24, name == "dst_key")
        if name == "transport":
            names = np.where(p["tcp"], 0, np.where(p["udp"], 1, 2))
            return pa.array(["TCP", "UDP", "ICMP"]).take(pa.array(names, mask=~(ported | p["icmp"])))
        if name in ("src_port", "dst_port"):
            return number(f.short(p["body"] + 2 * (name == "dst_port")), ported)
        if name == "tcp_flags":
            return number(f.byte(p["body"] + 13), p["tcp"])
        return number(f.byte(p["body"]), p["icmp"])

    def task(batches):
        for batch in batches:
            f = Frames(batch.column("raw"))
            p = places(f, layers.kinds(batch.column("linktype")))
            yield pa.RecordBatch.from_arrays([batch.column(x.name) for x in kept] + [column(c, f, p) for c in columns], [x.name for x in kept] + list(columns))

    return frames.select("raw", "linktype", *[x.name for x in kept]).mapInArrow(task, schema)
