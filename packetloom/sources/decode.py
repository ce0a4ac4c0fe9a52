"""Frames → packet rows, as columns over the raw bytes.

The fixed headers of the link, network and transport layers are read by one Arrow step (`layers`).  Of DNS messages, whose names
may point backwards, names and records are cut out in an Arrow UDF, and only for rows on DNS ports; HTTP and texts are columns.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import layers as fixed
from ..functions import labels
from ..functions.net import endpoint, ipv6_text
from ..functions.text import latin1

# HTTP methods, option names.
HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH", "TRACE", "CONNECT")
TCP_OPTIONS = {0: "eol", 1: "nop", 2: "mss", 3: "wscale", 4: "sack-permitted", 5: "sack", 8: "timestamps",
               28: "user-timeout", 29: "authentication", 34: "fast-open"}
PREVIEW_CHARS = 512

_EMPTY = "CAST('' AS BINARY)"


def _bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once.

    Later layers use it many times and filters will test it.  A plain projection would be
    copied into each use; a one-element ``inline`` is a step the optimizer leaves in place.
    """
    return df.select(*[c for c in df.columns if c != name], F.inline(F.array(F.struct(value.alias(name)))))


def _cut(data: Column, at, size) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    size = F.lit(size) if isinstance(size, int) else size
    return F.substring(data, (at + 1).cast("int"), size.cast("int"))


def _rest(data: Column, at) -> Column:
    return _cut(data, at, F.greatest(F.length(data), F.lit(0)))


def _number(data: Column, at, size: int) -> Column:
    """Big-endian unsigned number at an offset."""
    return F.conv(F.hex(_cut(data, at, size)), 16, 10).cast("long")


def _int(data: Column, at, size: int) -> Column:
    return _number(data, at, size).cast("int")


def _ipv4(data: Column, at: int) -> Column:
    return F.concat_ws(".", *[_number(data, at + i, 1).cast("string") for i in range(4)])


#: An option other than "end" and "nop" behind any number of "nop": kind, size and as many bytes as the size says, in hex.
_OPTION = r"\G(?:01)*((?!0[01])[0-9A-F]{2}(?:" + "|".join(f"{n:02X}[0-9A-F]{{{2 * n - 4}}}" for n in range(2, 41)) + "))"


def _tcp_options(data: Column) -> Column:
    """Option texts of an option block (40 bytes at most), up to the first that does not fit."""
    def number(option: Column, at: int, size: int) -> Column:
        return F.conv(F.substring(option, 2 * at + 1, 2 * size), 16, 10)

    def text(option: Column) -> Column:
        kind, size = number(option, 0, 1).cast("int"), F.length(option) / 2
        return (
            F.when((kind == 2) & (size == 4), F.concat(F.lit("mss="), number(option, 2, 2)))
            .when((kind == 3) & (size == 3), F.concat(F.lit("wscale="), number(option, 2, 1)))
            .when((kind == 8) & (size == 10), F.concat(F.lit("ts="), number(option, 2, 4), F.lit("/"), number(option, 6, 4)))
            .otherwise(F.coalesce(labels.lookup(kind, TCP_OPTIONS), F.concat(F.lit("opt-"), kind.cast("string"))))
        )
    return F.transform(F.regexp_extract_all(F.hex(data), F.lit(_OPTION), F.lit(1)), text)


def _transport(frames: DataFrame) -> DataFrame:
    """The texts of TCP options and the payload, from where the fixed headers say they stand."""
    raw, tcp = F.col("raw"), F.col("tcp")
    options = _tcp_options(_cut(raw, F.col("__options"), tcp["header_length"] - 20))
    rows = frames.transform(_bind, "tcp", F.when(F.col("__options").isNotNull(), tcp.withField("options", options)).otherwise(tcp))
    payload = F.when(F.col("__size") > 0, _cut(raw, F.col("__at"), F.col("__size"))).otherwise(F.expr(_EMPTY))
    made = ("eth", "arp", "ip", "tcp", "udp", "icmp", "payload", "errors")
    rows = rows.transform(_bind, "payload", payload).drop("__at", "__size", "__options")
    return rows.select(*[c for c in rows.columns if c not in made], *made)


DNS_SCHEMA = (
    "struct<ident:int,is_response:boolean,opcode:int,rcode:int,truncated:boolean,recursion_desired:boolean,"
    "questions:array<struct<name:string,qtype:int,qclass:int>>,"
    "answers:array<struct<name:string,rtype:int,rclass:int,ttl:bigint,data:string>>>"
)


def _dns_name(message: bytes, at: int) -> tuple[str, int]:
    """Name at an offset and the offset behind it; pointers are followed eight times at most."""
    parts, jumps, after = [], 0, None
    while True:
        size = message[at]
        if size == 0:
            return ".".join(parts), at + 1 if after is None else after
        if size >= 192:
            target = struct.unpack_from("!H", message, at)[0] & 0x3FFF
            after = at + 2 if after is None else after
            if jumps == 8:
                return ".".join(parts), after
            jumps, at = jumps + 1, target
            continue
        label = message[at + 1:at + 1 + size]
        if size >= 64 or len(label) < size:
            raise ValueError("bad label")
        text = label.decode("utf-8", "replace")
        parts.append(text)
        at += 1 + size


#: Wire layouts of what follows a name, and where in a record's data a name stands (by record type).
_ASKED, _ANSWERED = "!HH", "!HHIH"
_NAME_IN_DATA = {2: 0, 5: 0, 6: 0, 12: 0, 15: 2, 33: 6}


def _records(message: bytes, at: int, count: int, layout: str) -> tuple[list[tuple], int | None]:
    """Up to ``count`` records (name, fields…, offset of the data); the offset behind them, null after a fault."""
    found = []
    for _ in range(count):
        try:
            name, at = _dns_name(message, at)
            fields = struct.unpack_from(layout, message, at)
        except (ValueError, IndexError, struct.error):
            return found, None
        at += struct.calcsize(layout)
        size = fields[-1] if layout == _ANSWERED else 0
        if at + size > len(message):
            return found, None
        found.append((name, *fields, at))
        at += size
    return found, at


def _name_in(message: bytes, at: int) -> str | None:
    try:
        return _dns_name(message, at)[0]
    except (ValueError, IndexError, struct.error):
        return None


def _chunks(data: bytes) -> list[str]:
    """Length-prefixed texts; the last may be cut off."""
    out, at = [], 0
    while at < len(data):
        out.append(data[at + 1:at + 1 + data[at]].decode("utf-8", "replace"))
        at += 1 + data[at]
    return out


DNS_WIRE = (
    "struct<questions:array<struct<name:string,qtype:int,qclass:int>>,"
    "answers:array<struct<name:string,rtype:int,rclass:int,ttl:bigint,raw:binary,target:string,texts:array<string>>>>"
)
_QUESTION = [("name", pa.string()), ("qtype", pa.int32()), ("qclass", pa.int32())]
_ANSWER = [("name", pa.string()), ("rtype", pa.int32()), ("rclass", pa.int32()), ("ttl", pa.int64()), ("raw", pa.binary()),
           ("target", pa.string()), ("texts", pa.list_(pa.string()))]


def _list(counts: list[int], there: np.ndarray, columns: list[tuple], records: list[tuple]) -> pa.Array:
    """Records of all messages as one list a message, null where there is no message."""
    values = zip(*records) if records else [()] * len(columns)
    values = pa.StructArray.from_arrays([pa.array(v, kind) for v, (_, kind) in zip(values, columns)], names=[name for name, _ in columns])
    sizes = np.zeros(len(there), np.int64)
    sizes[there] = counts
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values, mask=pa.array(~there))


def _parse_dns():
    """Names and record borders of messages; what the data mean is said by columns."""
    @F.arrow_udf(DNS_WIRE)
    def parse(messages: pa.Array) -> pa.Array:
        there = messages.is_valid().to_numpy(zero_copy_only=False)
        questions, answers, asked, answered = [], [], [], []
        for m in messages.drop_null().to_pylist():
            n_questions, n_answers = struct.unpack_from("!HH", m, 4)
            found, at = _records(m, 12, n_questions, _ASKED)
            asked.append(len(found))
            questions += [(n, t, c) for n, t, c, _ in found]
            found = [] if at is None else _records(m, at, n_answers, _ANSWERED)[0]
            answered.append(len(found))
            answers += [(n, t, c, ttl, m[at:at + size], _name_in(m, at + _NAME_IN_DATA[t]) if t in _NAME_IN_DATA else None,
                         _chunks(m[at:at + size]) if t == 16 else None) for n, t, c, ttl, size, at in found]
        return pa.StructArray.from_arrays([_list(asked, there, _QUESTION, questions), _list(answered, there, _ANSWER, answers)], names=["questions", "answers"])

    return parse


def _record_text(answer: Column) -> Column:
    """What a record says, by type; the first 48 bytes in hexadecimal where it says nothing known."""
    raw, kind, size, target = answer["raw"], answer["rtype"], F.length(answer["raw"]), answer["target"]
    said = (
        F.when((kind == 1) & (size == 4), _ipv4(raw, 0)).when((kind == 28) & (size == 16), ipv6_text(raw))
        .when(kind.isin(2, 5, 12), target).when(kind == 6, F.concat(F.lit("soa "), target))
        .when((kind == 15) & (size > 2), F.concat(_number(raw, 0, 2).cast("string"), F.lit(" "), target))
        .when((kind == 33) & (size >= 6), F.concat(target, F.lit(":"), _number(raw, 4, 2).cast("string")))
        .when(kind == 16, F.array_join(answer["texts"], " "))
    )
    return F.coalesce(said, F.lower(F.hex(_cut(raw, 0, 48))))


def _dns(message: Column, wire: Column) -> Column:
    """The DNS layer of a message (twelve bytes at least) and what was read of its records."""
    flags = _int(message, 2, 2)
    answers = F.transform(wire["answers"], lambda a: F.struct(
        a["name"].alias("name"), a["rtype"].alias("rtype"), a["rclass"].alias("rclass"), a["ttl"].alias("ttl"), _record_text(a).alias("data")))
    bit = lambda n: flags.bitwiseAND(F.lit(n)) != 0
    return F.when(wire["questions"].isNotNull(), F.struct(
        _int(message, 0, 2).alias("ident"), bit(0x8000).alias("is_response"), F.floor(flags / 2048).cast("int").bitwiseAND(F.lit(15)).alias("opcode"),
        flags.bitwiseAND(F.lit(15)).alias("rcode"), bit(0x200).alias("truncated"), bit(0x100).alias("recursion_desired"),
        wire["questions"].alias("questions"), answers.alias("answers")))


_BLANK = r"[\s\x0b\x1c-\x1f\x85\xa0]"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_BLANK}+|{_BLANK}+$", "")


def _http(payload: Column) -> Column:
    """HTTP message of a payload; null when it does not look like one."""
    text = latin1(payload)
    looks = (F.length(payload) >= 16) & text.rlike("^(?:HTTP/|(?:" + "|".join(HTTP_METHODS) + ") )")

    def parse(t: Column) -> Column:
        crlf, lf = F.instr(t, "\r\n\r\n"), F.instr(t, "\n\n")
        cut = F.when(crlf > 0, crlf).when(lf > 0, lf).otherwise(F.length(t) + 1)
        gap = F.when(crlf > 0, 4).when(lf > 0, 2).otherwise(0)
        return F.struct(
            F.split(F.replace(F.substring(t, F.lit(1), cut - 1), F.lit("\r\n"), F.lit("\n")), "\n").alias("lines"),
            F.substring(t, cut + gap, F.length(t)).alias("body"))

    def build(m: Column) -> Column:
        lines, body = m["lines"], m["body"]
        entries = F.transform(
            F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: x.contains(":")),
            lambda x: F.struct(F.lower(_strip(F.substring_index(x, ":", 1))).alias("key"),
                               _strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
        keys = F.reverse(F.transform(entries, lambda e: e["key"]))
        last = F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == F.size(keys) - i)
        preview = F.regexp_replace(F.substring(body, 1, PREVIEW_CHARS), r"[\p{C}\p{Z}&&[^ ]]", ".")
        return F.struct(_strip(lines[0]).alias("start"), F.map_from_entries(last).alias("headers"),
                        preview.alias("body_preview"), F.length(body).alias("body_length"))

    def shaped(m: Column) -> Column:
        start = m["start"]
        words = F.split(start, " ")
        response = start.startswith("HTTP/")
        second, third = F.get(words, F.lit(1)), F.get(words, F.lit(2))
        status = F.when(second.rlike(r"^[+-]?[0-9]+$"), second.try_cast("int"))
        reason = F.when(F.size(words) > 2, F.substring(start, F.length(words[0]) + F.length(second) + 3, F.length(start)))
        nothing = F.lit(None).cast("string")

        def message(kind, method, path, version, status, reason):
            return F.struct(
                F.lit(kind).alias("kind"), method.alias("method"), path.alias("path"), version.alias("version"),
                status.alias("status"), reason.alias("reason"), m["headers"].alias("headers"),
                m["body_preview"].alias("body_preview"), m["body_length"].alias("body_length"))

        return F.when(response, message("response", nothing, nothing, words[0], status, reason)).when(
            F.size(words) >= 2,
            message("request", words[0], second, F.coalesce(third, F.lit("HTTP/1.0")), F.lit(None).cast("int"), nothing))

    def let(value, use):
        return F.transform(F.array(value), use)[0]

    return F.when(looks, let(text, lambda t: let(parse(t), lambda m: let(build(m), shaped))))


#: Layers in the order in which they are built; each needs the ones before `dns`, `dns` and `http` stand alone.
LAYERS = ("link", "network", "transport", "dns", "http")
_LAYER_TYPES = {
    **{name: fixed.TYPES[name] for name in ("ip", "tcp", "udp", "icmp")}, "payload": "binary", "dns": DNS_SCHEMA,
    "http": "struct<kind:string,method:string,path:string,version:string,status:int,reason:string,headers:map<string,string>,body_preview:string,body_length:int>",
}


def decode(frames: DataFrame, layers=LAYERS, questions: int = 64, answers: int = 128) -> DataFrame:
    """Frames with ``ts, raw, wire_length, linktype`` (other columns are kept) → packet rows.

    Only the named layers are built: ``("link",)`` costs no work above the link header, and without ``dns`` no names are
    looked for; columns of the layers left out are null.  Without ``dns`` a message on a DNS port may be read as HTTP.
    DNS messages that claim more than ``questions`` or ``answers`` (fixed values by default) are not read; that is
    among the ``errors``.
    """
    transport = bool(set(layers) & {"transport", "dns", "http"})
    rows = fixed.nested(frames, network=bool(set(layers) - {"link"}), transport=transport)
    if transport:
        rows = _transport(rows)
    if "dns" in layers:
        has_payload = F.length("payload") > 0
        message = F.when(F.col("tcp").isNotNull() & (F.length("payload") > 2), _rest(F.col("payload"), 2)).otherwise(F.col("payload"))
        rows = rows.transform(_bind, "__dns", F.when(F.col("__named") & has_payload & (F.length(message) >= 12), message))
        claims = (_int(F.col("__dns"), 4, 2) > questions) | (_int(F.col("__dns"), 6, 2) > answers)
        rows = rows.transform(_bind, "__claims", F.coalesce(claims, F.lit(False)))
        rows = rows.withColumn("errors", F.when(F.col("__claims"), F.array_append("errors", F.lit("DNS message claims too many records"))).otherwise(F.col("errors")))
        rows = rows.transform(_bind, "__dns", F.when(~F.col("__claims"), F.col("__dns")))
        rows = rows.transform(_bind, "__wire", _parse_dns()(F.col("__dns")))
        rows = rows.transform(_bind, "dns", _dns(F.col("__dns"), F.col("__wire"))).drop("__dns", "__wire", "__claims")
    rows = rows.drop("__named")
    if "http" in layers:
        free = F.col("tcp").isNotNull() & (F.col("dns").isNull() if "dns" in layers else F.lit(True))
        rows = rows.transform(_bind, "http", F.when(free, _http(F.col("payload"))))
    for name, kind in _LAYER_TYPES.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows


# ---- derived columns and projections ----------------------------------------------------

def protocol_label() -> Column:
    return (
        F.when(F.col("dns").isNotNull(), F.lit("DNS"))
        .when(F.col("http").isNotNull(), F.lit("HTTP"))
        .when(F.col("tcp").isNotNull(), F.lit("TCP"))
        .when(F.col("udp").isNotNull(), F.lit("UDP"))
        .when(F.col("icmp").isNotNull(), F.lit("ICMP"))
        .when(F.col("arp").isNotNull(), F.lit("ARP"))
        .when(F.col("ip").isNotNull(), labels.ip_protocol_name(F.col("ip.proto")))
        .when(F.col("eth").isNotNull(), F.concat(F.lit("ETH-"), labels.hex4(F.col("eth.ethertype"))))
        .otherwise(F.lit("UNKNOWN"))
    )


def transport_label() -> Column:
    return (F.when(F.col("tcp").isNotNull(), F.lit("TCP")).when(F.col("udp").isNotNull(), F.lit("UDP"))
            .when(F.col("icmp").isNotNull(), F.lit("ICMP")))


def flatten(packets: DataFrame) -> DataFrame:
    """Packet rows with the columns the predicates, statistics and rules read."""
    ids = [F.struct("file", "frame_no").alias("pkt_id")] if "frame_no" in packets.columns else [F.col("pkt_id")]
    return packets.select(
        *ids, "ts", F.col("wire_length").alias("length"), F.length("raw").alias("captured_length"),
        F.col("eth.ethertype").alias("ethertype"), F.col("ip.version").alias("ip_version"),
        F.coalesce("ip.src", "arp.sender_ip").alias("src_ip"), F.coalesce("ip.dst", "arp.target_ip").alias("dst_ip"),
        F.coalesce("tcp.sport", "udp.sport").alias("src_port"), F.coalesce("tcp.dport", "udp.dport").alias("dst_port"),
        transport_label().alias("transport"), protocol_label().alias("protocol"), F.col("tcp.flags").alias("tcp_flags"),
        F.col("icmp.type").alias("icmp_type"), "eth", "arp", "ip", "tcp", "udp", "icmp", "dns", "http", "payload", "errors",
    )


def dns_questions(flat: DataFrame, first_only: bool = False) -> DataFrame:
    """One row per question of each query packet."""
    asked = flat.filter(~F.col("dns.is_response") & (F.size("dns.questions") > 0))
    chosen = F.slice("dns.questions", 1, 1) if first_only else F.col("dns.questions")
    return asked.select("pkt_id", "ts", "src_ip", "dst_ip", F.explode(chosen).alias("q")).select(
        "pkt_id", "ts", "src_ip", "dst_ip", F.col("q.name").alias("qname"), F.col("q.qtype").alias("qtype"))


def _none_text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("None"))


def dns_summary() -> Column:
    question = F.get(F.col("dns.questions"), F.lit(0))
    data = F.array_join(F.transform(F.slice("dns.answers", 1, 3), lambda a: a["data"]), ",")
    reply = F.concat(F.lit(" -> "), F.when(data != "", data).otherwise(labels.dns_rcode_name(F.col("dns.rcode"))))
    return F.concat(
        F.lit("DNS "), F.when(F.col("dns.is_response"), F.lit("response ")).otherwise(F.lit("query ")),
        F.coalesce(labels.dns_type_name(question["qtype"]), F.lit("?")), F.lit(" "),
        F.coalesce(question["name"], F.lit("?")), F.when(F.col("dns.is_response"), reply).otherwise(F.lit("")))


def http_summary() -> Column:
    http = F.col("http")
    return F.when(
        http["kind"] == "request",
        F.concat(F.lit("HTTP "), _none_text(http["method"]), F.lit(" "), F.coalesce(http["headers"]["host"], F.lit("")),
                 _none_text(http["path"])),
    ).otherwise(F.trim(F.concat(F.lit("HTTP "), _none_text(http["status"]), F.lit(" "), F.coalesce(http["reason"], F.lit("")))))


def summary() -> Column:
    """One line of text per flat packet row."""
    ends = F.concat(endpoint(F.col("src_ip"), F.col("eth.src"), F.col("src_port")), F.lit(" > "),
                    endpoint(F.col("dst_ip"), F.col("eth.dst"), F.col("dst_port")))
    return (
        F.when(F.col("http").isNotNull(), F.concat_ws(" ", ends, http_summary()))
        .when(F.col("dns").isNotNull(), F.concat_ws(" ", ends, dns_summary()))
        .when(F.col("tcp").isNotNull(), F.format_string(
            "%s TCP [%s] seq=%d win=%d len=%d", ends, labels.flag_text(F.col("tcp.flags")), "tcp.seq", "tcp.window", "tcp.payload_length"))
        .when(F.col("udp").isNotNull(), F.format_string("%s UDP len=%d", ends, "udp.payload_length"))
        .when(F.col("icmp").isNotNull(), F.format_string(
            "%s ICMP %s id=%s len=%d", ends, labels.icmp_type_name(F.col("icmp.type")), _none_text(F.col("icmp.ident")), "icmp.payload_length"))
        .when(F.col("arp").isNotNull(), F.format_string(
            "ARP %s %s -> %s", labels.arp_operation_name(F.col("arp.opcode")), "arp.sender_ip", "arp.target_ip"))
        .otherwise(F.format_string("%s %s len=%d", ends, "protocol", "length"))
    )


def records(flat: DataFrame) -> DataFrame:
    """Short record per packet; texts of absent layers are null."""
    return flat.select(
        "ts", "protocol", "length", F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"),
        F.col("src_port").alias("sport"), F.col("dst_port").alias("dport"),
        labels.flag_text(F.col("tcp.flags")).alias("tcp_flags"),
        F.when(F.col("dns").isNotNull(), dns_summary()).alias("dns"),
        F.when(F.col("http").isNotNull(), http_summary()).alias("http"))


def monitor_rows(packets: DataFrame) -> DataFrame:
    """The monitor's flat IPv4 table: six flag names, short protocol names."""
    ip = F.col("ip")
    return packets.filter(ip["version"] == 4).select(
        "ts", ip["src"].alias("src_ip"), ip["dst"].alias("dst_ip"), F.coalesce("tcp.sport", "udp.sport").alias("src_port"),
        F.coalesce("tcp.dport", "udp.dport").alias("dst_port"), labels.monitor_protocol_name(ip["proto"]).alias("protocol"),
        F.when(ip["total_length"] > 0, ip["total_length"]).otherwise(F.length("raw")).cast("int").alias("length"),
        labels.monitor_flag_text(F.col("tcp.flags")).alias("flags"))
