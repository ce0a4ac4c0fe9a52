"""The fixed headers of frames, read for a whole batch at once.

Link header and VLAN tags, ARP, IPv4, IPv6 with its extension headers, TCP, UDP and ICMP stand at offsets that NumPy computes for
all frames of an Arrow batch.  `decode` takes them as nested layers, `headers` as flat columns.
"""

from __future__ import annotations

import socket

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# Link types, ethertypes, protocol numbers, DNS ports.
LINK_NULL, LINK_ETHERNET, LINK_RAW, LINK_SLL = 0, 1, 101, 113
ETHERTYPE_IP, ETHERTYPE_IPV6, ETHERTYPE_ARP = 0x0800, 0x86DD, 0x0806
VLAN_TAGS = (0x8100, 0x88A8, 0x9100)
IPV6_EXTENSIONS = (0, 43, 44, 60)
LOOPBACK_IPV6_FAMILIES = (24, 28, 30)
DNS_PORTS = (53, 853, 5353, 5355)
ICMP_WITH_IDENT = (0, 8, 13, 14, 128, 129)
NO_MAC = "00:00:00:00:00:00"

TYPES = {
    "eth": "struct<src:string,dst:string,ethertype:int,vlan:int>",
    "arp": "struct<opcode:int,sender_mac:string,sender_ip:string,target_mac:string,target_ip:string>",
    "ip": "struct<version:int,src:string,dst:string,proto:int,ttl:int,total_length:int,header_length:int,ident:int,flags:int,frag_offset:int,tos:int>",
    "tcp": "struct<sport:int,dport:int,seq:bigint,ack:bigint,flags:int,window:int,header_length:int,checksum:int,urgent:int,options:array<string>,payload_length:int>",
    "udp": "struct<sport:int,dport:int,length:int,checksum:int,payload_length:int>",
    "icmp": "struct<type:int,code:int,checksum:int,ident:int,seq:int,payload_length:int>",
    "errors": "array<string>",
}
#: What a frame can be wrong by; the text of the first also names the link type.
ERRORS = ("unsupported linktype ", "truncated link header", "truncated IP header", "non-initial fragment",
          "truncated TCP header", "truncated UDP header", "truncated ICMP header")


class Frames:
    """The bytes of a batch of frames, read at one offset a frame."""

    def __init__(self, raw: pa.Array):
        raw = raw.cast(pa.large_binary())
        raw = pc.fill_null(raw, b"") if raw.null_count else raw
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
        data = raw.buffers()[2]
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        self.start, self.size = offsets[:-1], np.diff(offsets)

    def byte(self, at) -> np.ndarray:
        """The byte at an offset of each frame; any value behind its end."""
        return self.data[np.minimum(self.start + at, len(self.data) - 1)].astype(np.int64)

    def short(self, at) -> np.ndarray:
        return self.byte(at) << 8 | self.byte(at + 1)

    def word(self, at) -> np.ndarray:
        return self.short(at) << 16 | self.short(at + 2)

    def cells(self, at, width: int, rows: np.ndarray) -> np.ndarray:
        """(rows, width) bytes at offsets of some frames."""
        return self.data[(self.start[rows] + np.broadcast_to(at, self.size.shape)[rows])[:, None] + np.arange(width)]


def places(f: Frames, kind: np.ndarray) -> dict[str, np.ndarray]:
    """Where everything stands: offsets, flags and numbers of each frame; a link type below zero is an unknown one."""
    ether = (kind == LINK_ETHERNET) & (f.size >= 14)
    tags, more = np.zeros(len(kind), np.int64), ether.copy()
    while True:
        more = more & np.isin(f.short(12 + 4 * tags), VLAN_TAGS) & (f.size >= 18 + 4 * tags)
        if not more.any():
            break
        tags = tags + more
    cooked, loop = (kind == LINK_SLL) & (f.size >= 16), (kind == LINK_NULL) & (f.size >= 4)
    family = sum(f.byte(i) << (8 * i) for i in range(4))
    has_eth = ether | cooked | loop
    ethertype = np.where(ether, f.short(12 + 4 * tags), np.where(cooked, f.short(14), np.where(np.isin(family, LOOPBACK_IPV6_FAMILIES), ETHERTYPE_IPV6, ETHERTYPE_IP)))
    net = np.where(ether, 14 + 4 * tags, np.where(cooked, 16, np.where(loop, 4, 0)))
    size = f.size - net
    is_arp = has_eth & (ethertype == ETHERTYPE_ARP)
    arp = is_arp & (size >= 28) & (f.byte(net + 4) == 6) & (f.byte(net + 5) == 4)
    is_ip = (kind == LINK_RAW) | (has_eth & np.isin(ethertype, (ETHERTYPE_IP, ETHERTYPE_IPV6)))
    packet = is_ip & (size > 0)
    first = f.byte(net)
    version, ihl = first >> 4, (first & 15) * 4
    four = packet & (version == 4) & (size >= 20) & (ihl >= 20) & (size >= ihl)
    six = packet & (version == 6) & (size >= 40)
    proto = np.where(four, f.byte(net + 9), f.byte(net + 6))
    head = np.where(four, ihl, 40)
    walk = six & np.isin(proto, IPV6_EXTENSIONS)
    while True:
        walk = walk & np.isin(proto, IPV6_EXTENSIONS) & (size >= head + 8)
        if not walk.any():
            break
        following = f.byte(net + head)
        # the fixed length of a fragment header counts for the header that follows the byte that names it
        length = np.where(following == 44, 8, (f.byte(net + head + 1) + 1) * 8)
        proto, head = np.where(walk, following, proto), np.where(walk, head + length, head)
    total = f.short(net + 2)
    stop = np.where(four & (total > 0) & (total <= size), total, size)
    frag = f.short(net + 6)
    fragment = four & (frag % 8192 > 0)
    whole = (four | six) & ~fragment
    body, length = net + head, np.maximum(stop - head, 0)
    room = np.where(whole, length, -1)
    tcp, udp = (proto == 6) & (room >= 20), (proto == 17) & (room >= 8)
    icmp = np.isin(proto, (1, 58)) & (room >= 4)
    return {"ether": ether, "cooked": cooked, "loop": loop, "has_eth": has_eth, "ethertype": ethertype, "tags": tags, "net": net, "size": size,
            "is_arp": is_arp, "arp": arp, "is_ip": is_ip, "packet": packet, "version": version, "four": four, "six": six, "proto": proto, "head": head,
            "total": total, "frag": frag, "fragment": fragment, "whole": whole, "body": body, "length": length, "room": room,
            "tcp": tcp, "udp": udp, "icmp": icmp}


def texts(f: Frames, *parts) -> pa.Array:
    """Texts of cells, by parts of the batch (rows, offset, width, how a cell is written); each distinct cell is written once."""
    out = np.full(len(f.size), -1, np.int64)
    written: list[str] = []
    for rows, at, width, write in parts:
        rows = np.flatnonzero(rows)
        if len(rows):
            cells = np.ascontiguousarray(f.cells(at, width, rows))
            coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(cells)]).dictionary_encode()
            out[rows] = coded.indices.to_numpy() + len(written)
            written += [write(x) for x in coded.dictionary.to_pylist()]
    return pa.array(written, pa.string()).take(pa.array(out, mask=out < 0))


def ipv4_text(cell: bytes) -> str:
    return socket.inet_ntop(socket.AF_INET, cell)


def ipv6_text(cell: bytes) -> str:
    return socket.inet_ntop(socket.AF_INET6, cell)


def _mac(cell: bytes) -> str:
    return cell.hex(":")


def _no_mac(_: bytes) -> str:
    return NO_MAC


def _cooked_mac(cell: bytes) -> str:
    """A length in two bytes and an address of eight bytes at most."""
    size = min(cell[0] << 8 | cell[1], 8)
    return cell[2:2 + size].hex(":") if size else NO_MAC


def _struct(kind: str, there: np.ndarray, **fields) -> pa.Array:
    """A layer: null where it is not there; fields are numbers, (numbers, where they are known) or made arrays."""
    declared = dict(x.split(":", 1) for x in kind.removeprefix("struct<").removesuffix(">").split(","))

    def array(name: str, value) -> pa.Array:
        if isinstance(value, pa.Array):
            return value
        value, known = value if isinstance(value, tuple) else (value, None)
        return pa.array(value.astype(np.int64 if declared[name] == "bigint" else np.int32), mask=None if known is None else ~known)

    return pa.StructArray.from_arrays([array(n, fields[n]) for n in declared], names=list(declared), mask=pa.array(~there))


def _eth(f: Frames, p: dict) -> pa.Array:
    return _struct(
        TYPES["eth"], p["has_eth"], src=texts(f, (p["ether"], 6, 6, _mac), (p["cooked"], 4, 10, _cooked_mac), (p["loop"], 0, 1, _no_mac)),
        dst=texts(f, (p["ether"], 0, 6, _mac), (p["cooked"] | p["loop"], 0, 1, _no_mac)), ethertype=p["ethertype"], vlan=(f.short(14) & 4095, p["tags"] > 0))


def _arp(f: Frames, p: dict) -> pa.Array:
    there, net = p["arp"], p["net"]
    return _struct(
        TYPES["arp"], there, opcode=f.short(net + 6), sender_mac=texts(f, (there, net + 8, 6, _mac)), sender_ip=texts(f, (there, net + 14, 4, ipv4_text)),
        target_mac=texts(f, (there, net + 18, 6, _mac)), target_ip=texts(f, (there, net + 24, 4, ipv4_text)))


def _ip(f: Frames, p: dict) -> pa.Array:
    four, six, net = p["four"], p["six"], p["net"]
    either = lambda a, b: np.where(four, a, b)
    return _struct(
        TYPES["ip"], four | six, version=either(4, 6), src=texts(f, (four, net + 12, 4, ipv4_text), (six, net + 8, 16, ipv6_text)),
        dst=texts(f, (four, net + 16, 4, ipv4_text), (six, net + 24, 16, ipv6_text)), proto=p["proto"], ttl=f.byte(net + either(8, 7)),
        total_length=either(p["total"], f.short(net + 4) + 40), header_length=p["head"], ident=either(f.short(net + 4), 0),
        flags=either(p["frag"] // 8192, 0), frag_offset=either(p["frag"] % 8192 * 8, 0), tos=either(f.byte(net + 1), 0))


def _transport(f: Frames, p: dict) -> dict[str, pa.Array]:
    """TCP (its options are texts to be made from the bytes at ``__options``), UDP, ICMP and the place of the payload in the frame."""
    at, room, tcp, udp, icmp = p["body"], p["room"], p["tcp"], p["udp"], p["icmp"]
    claimed = (f.byte(at + 12) >> 4) * 4
    head = np.where((claimed < 20) | (claimed > room), 20, claimed)
    declared = f.short(at + 4)
    udp_size = np.where((declared > 8) & (declared <= room), declared - 8, room - 8)
    ident = np.isin(f.byte(at), ICMP_WITH_IDENT) & (room >= 8)
    icmp_head = np.where(ident, 8, 4)
    none = pa.ListArray.from_arrays(pa.array(np.zeros(len(at) + 1, np.int32)), pa.array([], pa.string()))
    ports = {"sport": f.short(at), "dport": f.short(at + 2)}
    link_data = ~p["is_ip"] & ~p["is_arp"] & p["has_eth"]
    other = p["packet"] & ~np.isin(p["version"], (4, 6))
    start = np.select([tcp, udp, icmp, link_data | other], [at + head, at + 8, at + icmp_head, p["net"]], at)
    size = np.select([tcp, udp, icmp, link_data | other, p["four"] | p["six"]], [room - head, udp_size, room - icmp_head, p["size"], p["length"]], 0)
    return {
        "tcp": _struct(
            TYPES["tcp"], tcp, **ports, seq=f.word(at + 4), ack=f.word(at + 8), flags=f.byte(at + 13), window=f.short(at + 14), header_length=head,
            checksum=f.short(at + 16), urgent=f.short(at + 18), options=none, payload_length=room - head),
        "udp": _struct(TYPES["udp"], udp, **ports, length=declared, checksum=f.short(at + 6), payload_length=udp_size),
        "icmp": _struct(TYPES["icmp"], icmp, type=f.byte(at), code=f.byte(at + 1), checksum=f.short(at + 2), ident=(f.short(at + 4), ident),
                        seq=(f.short(at + 6), ident), payload_length=room - icmp_head),
        "__at": pa.array(start.astype(np.int32)), "__size": pa.array(size.astype(np.int32)),
        "__named": pa.array((tcp | udp) & (np.isin(ports["sport"], DNS_PORTS) | np.isin(ports["dport"], DNS_PORTS))),
        "__options": pa.array((at + 20).astype(np.int32), mask=~(tcp & (head > 20))),
    }


def _errors(p: dict, kind: np.ndarray, network: bool, transport: bool) -> pa.Array:
    """The first thing that is wrong with each frame, as a list of one text or none."""
    known = np.isin(kind, (LINK_NULL, LINK_ETHERNET, LINK_RAW, LINK_SLL))
    proto, whole = p["proto"], p["whole"]
    found = [(~known & p["typed"]), known & (kind != LINK_RAW) & ~p["has_eth"]]
    if network:
        found += [p["packet"] & ~p["four"] & ~p["six"] & np.isin(p["version"], (4, 6)), p["fragment"]]
    if transport:
        found += [whole & (proto == 6) & ~p["tcp"], whole & (proto == 17) & ~p["udp"], whole & np.isin(proto, (1, 58)) & ~p["icmp"]]
    which = np.select(found, range(len(found)), -1)
    rows = np.flatnonzero(which >= 0)
    names = [ERRORS[w] + (str(kind[row]) if w == 0 else "") for row, w in zip(rows, which[rows])]
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(which >= 0))).astype(np.int32)), pa.array(names, pa.string()))


def kinds(linktype: pa.Array) -> np.ndarray:
    return pc.fill_null(linktype, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def nested(frames: DataFrame, network: bool = True, transport: bool = True) -> DataFrame:
    """Frames (``raw, linktype`` and others, which are kept) → their layers as structs and ``errors``.

    With ``transport`` also where payload (``__at``, ``__size``) and TCP options (``__options``) stand in the frame, and whether one of
    the ports is a DNS port (``__named``).
    """
    types = {n: TYPES[n] for n in ("eth", "arp", *(("ip",) if network else ()), *(("tcp", "udp", "icmp") if transport else ()))}
    types |= ({"__at": "int", "__size": "int", "__options": "int", "__named": "boolean"} if transport else {}) | {"errors": TYPES["errors"]}
    kept = [x for x in frames.schema if x.name not in types]
    schema = StructType([*kept, *StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in types.items()))])

    def task(batches):
        for batch in batches:
            f, kind = Frames(batch.column("raw")), kinds(batch.column("linktype"))
            p = places(f, kind)
            p["typed"] = batch.column("linktype").is_valid().to_numpy(zero_copy_only=False)
            made = {"eth": _eth(f, p), "arp": _arp(f, p), "errors": _errors(p, kind, network, transport)}
            if network:
                made["ip"] = _ip(f, p)
            if transport:
                made |= _transport(f, p)
            yield pa.RecordBatch.from_arrays([batch.column(x.name) for x in kept] + [made[n] for n in types], [x.name for x in kept] + list(types))

    return frames.select(*[x.name for x in kept]).mapInArrow(task, schema)
