"""Builders of test frames and capture files."""

from __future__ import annotations

import socket
import struct

MAC_A, MAC_B = bytes.fromhex("aabbccddee01"), bytes.fromhex("aabbccddee02")


def tcp(sport, dport, flags, payload=b"", options=b"", seq=1, window=512):
    words = (20 + len(options)) // 4
    return struct.pack("!HHIIBBHHH", sport, dport, seq, 7, words << 4, flags, window, 0xBEEF, 0) + options + payload


def udp(sport, dport, payload=b"", length=None):
    return struct.pack("!HHHH", sport, dport, 8 + len(payload) if length is None else length, 9) + payload


def icmp(kind, code, ident, seq, payload=b""):
    return struct.pack("!BBHHH", kind, code, 3, ident, seq) + payload


def ipv4(src, dst, proto, body, ttl=64, frag=0, total=None, options=b""):
    ihl = 5 + len(options) // 4
    head = struct.pack("!BBHHHBBH4s4s", 0x40 | ihl, 0, 20 + len(options) + len(body) if total is None else total, 77, frag,
                       ttl, proto, 0, socket.inet_aton(src), socket.inet_aton(dst))
    return head + options + body


def ipv6(src, dst, proto, body, payload_length=None):
    return struct.pack("!IHBB", 6 << 28, len(body) if payload_length is None else payload_length, proto, 33) + socket.inet_pton(
        socket.AF_INET6, src) + socket.inet_pton(socket.AF_INET6, dst) + body


def ether(body, ethertype=0x0800, vlans=()):
    tags = b"".join(struct.pack("!HH", tag, tci) for tag, tci in vlans)
    return MAC_B + MAC_A + tags + struct.pack("!H", ethertype) + body


def dns_name(name):
    return b"".join(bytes([len(p)]) + p.encode() for p in name.split(".")) + b"\0"


def dns_query(ident, name, qtype=1, more=()):
    questions = [(name, qtype), *more]
    return struct.pack("!HHHHHH", ident, 0x0100, len(questions), 0, 0, 0) + b"".join(
        dns_name(n) + struct.pack("!HH", t, 1) for n, t in questions)


def dns_answer(rtype, data, owner=b"\xc0\x0c"):
    return owner + struct.pack("!HHIH", rtype, 1, 4000000000, len(data)) + data


def dns_response(ident, name, answers, flags=0x8180):
    return struct.pack("!HHHHHH", ident, flags, 1, len(answers), 0, 0) + dns_name(name) + struct.pack(
        "!HH", 1, 1) + b"".join(answers)


def pcap(records, order="<", nano=False, linktype=1):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, linktype)
    for sec, frac, data, wire in records:
        out += struct.pack(order + "IIII", sec, frac, len(data), wire) + data
    return out
