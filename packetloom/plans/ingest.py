"""Queries that build frames from the views, decode them and compare with the view's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules, stats
from ..session import materialize, spread
from ..sources import decode, headers
from .registry import greedy, query
from .traffic import FLAG_TEXT, QTYPE_NAME, http, icmp, packets


LAYERS_HEADERS = ("link", "network", "transport")
LAYERS_HTTP = (*LAYERS_HEADERS, "http")
ETHERNET = "aabbccddee02aabbccddee010800"


def _hex(column, digits):
    return F.lpad(F.hex(column.cast("long")), digits, "0")


def _ip_hex(ip):
    return F.array_join(F.transform(F.split(ip, r"\."), lambda o: F.lpad(F.hex(o.cast("int")), 2, "0")), "")


def _ip_packet(proto, src, dst, body):
    """Hex of an IPv4 packet around a body in hex."""
    total = F.length(body) / 2 + 20
    return F.concat(F.lit("4500"), _hex(total, 4), F.lit("004d000040"), _hex(proto, 2), F.lit("0000"),
                    _ip_hex(src), _ip_hex(dst), body)


def _tcp(sport, dport, seq, flags, payload):
    return F.concat(_hex(sport, 4), _hex(dport, 4), _hex(seq, 8), F.lit("00000007"), F.lit("50"), _hex(flags, 2),
                    F.lit("0200beef0000"), payload)


def _frames(df, hexed, linktype):
    """Frames as a stored table, the way an ingest job leaves them."""
    return materialize(spread(df).select(
        "pkt_id", "ts", F.unhex(hexed).alias("raw"), F.col("length").cast("long").alias("wire_length"),
        linktype.cast("long").alias("linktype")))


def packet_frames(spark, sf_dir):
    """TCP rows as Ethernet frames (some with a VLAN tag), UDP rows as raw IP with a DNS query."""
    p = packets(spark, sf_dir)
    labels = F.array_join(F.transform(
        F.split("qname", r"\."), lambda x: F.concat(F.lpad(F.hex(F.length(x)), 2, "0"), F.hex(x))), "")
    question = F.concat(F.lit("000101000001000000000000"), labels, F.lit("00"), _hex(F.col("qtype"), 4), F.lit("0001"))
    udp = F.concat(_hex(F.col("src_port"), 4), _hex(F.col("dst_port"), 4), _hex(F.length(question) / 2 + 8, 4), F.lit("0000"), question)
    tcp = _tcp(F.col("src_port"), F.col("dst_port"), F.col("pkt_id") % F.lit(2**32), F.col("tcp_flags"), F.lit(""))
    is_tcp = F.col("transport") == "TCP"
    vlan = F.when(F.col("src_port") % 3 == 0, F.lit("aabbccddee02aabbccddee018100006408" + "00")).otherwise(F.lit(ETHERNET))
    hexed = F.when(is_tcp, F.concat(vlan, _ip_packet(F.lit(6), F.col("src_ip"), F.col("dst_ip"), tcp))).otherwise(
        _ip_packet(F.lit(17), F.col("src_ip"), F.col("dst_ip"), udp))
    return _frames(p, hexed, F.when(is_tcp, 1).otherwise(101))


def decoded_packets(spark, sf_dir):
    return decode.flatten(decode.decode(packet_frames(spark, sf_dir)))


def http_frames(spark, sf_dir):
    h = http(spark, sf_dir).withColumn("length", F.length("payload"))
    body = _tcp(F.col("src_port"), F.col("dst_port"), F.col("pkt_id"), F.col("tcp_flags"), F.hex("payload"))
    return _frames(h, F.concat(F.lit(ETHERNET), _ip_packet(F.lit(6), F.col("src_ip"), F.col("dst_ip"), body)), F.lit(1))


def icmp_frames(spark, sf_dir):
    i = icmp(spark, sf_dir)
    body = F.concat(_hex(F.col("icmp_type"), 2), F.lit("00"), F.lit("1234"), _hex(F.col("pkt_id") % 65536, 4), F.lit("0007"), F.col("payload_hex"))
    return _frames(i, F.concat(F.lit(ETHERNET), _ip_packet(F.lit(1), F.col("src_ip"), F.col("dst_ip"), body)), F.lit(1))


@query("decode_packets", "packets", sql="""
SELECT pkt_id, ts, CAST(length AS BIGINT) AS length, src_ip, dst_ip, src_port, dst_port, protocol AS transport,
  CASE protocol WHEN 'TCP' THEN 'TCP' ELSE 'DNS' END AS protocol, tcp_flags, qname, qtype,
  CASE WHEN protocol = 'TCP' THEN pkt_id % 4294967296 END AS seq,
  CAST(CASE WHEN protocol = 'TCP' AND src_port % 3 = 0 THEN 100 END AS INT) AS vlan FROM packets""")
def decode_packets(spark, sf_dir):
    question = F.get(F.col("dns.questions"), F.lit(0))
    return decoded_packets(spark, sf_dir).select(
        "pkt_id", "ts", "length", "src_ip", "dst_ip", "src_port", "dst_port", "transport", "protocol", "tcp_flags",
        question["name"].alias("qname"), question["qtype"].alias("qtype"), F.col("tcp.seq").alias("seq"),
        F.col("eth.vlan").alias("vlan"))


@query("decode_headers", "packets", sql="""
SELECT pkt_id, ts, CAST(length AS BIGINT) AS length, src_ip, dst_ip, src_port, dst_port, protocol AS transport, tcp_flags,
  CAST(CASE WHEN protocol = 'TCP' AND src_port % 3 = 0 THEN 100 END AS INT) AS vlan, '4:' || printf('%02x%02x%02x%02x',
  split_part(src_ip, '.', 1)::INT, split_part(src_ip, '.', 2)::INT, split_part(src_ip, '.', 3)::INT, split_part(src_ip, '.', 4)::INT) AS src_key FROM packets""")
def decode_headers(spark, sf_dir):
    """Flat header columns in one pass over the bytes."""
    wanted = ("src_ip", "dst_ip", "src_port", "dst_port", "transport", "tcp_flags", "vlan", "src_key")
    return headers.flat(packet_frames(spark, sf_dir), wanted).withColumnRenamed("wire_length", "length")


@query("decode_http", "http_messages", sql="""
SELECT pkt_id, method, path, 'HTTP/1.1' AS version, http_host AS host, "authorization", CAST(length(body) AS INT) AS body_length, body AS body_preview
FROM http_messages""")
def decode_http(spark, sf_dir):
    rows = decode.decode(http_frames(spark, sf_dir), LAYERS_HTTP)
    headers = F.col("http.headers")
    return rows.select("pkt_id", "http.method", "http.path", "http.version", headers["host"].alias("host"),
                       headers["authorization"].alias("authorization"), "http.body_length", "http.body_preview")


@query("decode_icmp", "icmp_packets", sql="""
SELECT pkt_id, icmp_type AS type, CAST(pkt_id % 65536 AS INT) AS ident, CAST(7 AS INT) AS seq,
  CAST(length(payload_hex) // 2 AS INT) AS payload_length, upper(payload_hex) AS payload FROM icmp_packets""")
def decode_icmp(spark, sf_dir):
    rows = decode.decode(icmp_frames(spark, sf_dir), LAYERS_HEADERS)
    return rows.select("pkt_id", "icmp.type", "icmp.ident", "icmp.seq", "icmp.payload_length", F.hex("payload").alias("payload"))


@query("stats_ethertype", "packets", sql="""
SELECT '0x0800' AS ethertype, count(*) AS packets FROM packets WHERE protocol = 'TCP'""")
def stats_ethertype(spark, sf_dir):
    return stats.by_ethertype(decode.flatten(decode.decode(packet_frames(spark, sf_dir), ("link",)))).drop("first_seen")


SUMMARY = f"""CASE protocol WHEN 'TCP' THEN src_ip || ':' || src_port || ' > ' || dst_ip || ':' || dst_port || ' TCP [' || {FLAG_TEXT} || '] seq=' || (pkt_id % 4294967296) || ' win=512 len=0'
  ELSE src_ip || ':' || src_port || ' > ' || dst_ip || ':' || dst_port || ' DNS query ' || {QTYPE_NAME} || ' ' || qname END"""


@query("packet_summary", "packets", sql=f"SELECT pkt_id, ts, {SUMMARY} AS summary FROM packets")
def packet_summary(spark, sf_dir):
    return decoded_packets(spark, sf_dir).select("pkt_id", "ts", decode.summary().alias("summary"))


@query("packet_records", "packets", sql=f"""
SELECT ts, CASE protocol WHEN 'TCP' THEN 'TCP' ELSE 'DNS' END AS protocol, CAST(length AS BIGINT) AS length, src_ip AS src, dst_ip AS dst,
  src_port AS sport, dst_port AS dport, CASE WHEN tcp_flags IS NOT NULL THEN {FLAG_TEXT} END AS tcp_flags,
  CASE protocol WHEN 'UDP' THEN 'DNS query ' || {QTYPE_NAME} || ' ' || qname END AS dns, CAST(NULL AS VARCHAR) AS http FROM packets""")
def packet_records(spark, sf_dir):
    return decode.records(decoded_packets(spark, sf_dir))


@query("monitor_rows", "packets", sql=f"""
SELECT ts, src_ip, dst_ip, src_port, dst_port, protocol, CAST(CASE protocol WHEN 'TCP' THEN 40
  ELSE 20 + 8 + 12 + length(qname) + 2 + 4 END AS INT) AS length, CASE WHEN tcp_flags IS NOT NULL THEN {FLAG_TEXT} END AS flags FROM packets""")
def monitor_rows(spark, sf_dir):
    return decode.monitor_rows(decode.decode(packet_frames(spark, sf_dir), LAYERS_HEADERS))


@query("rule_stealth_decoded", "packets", sql=greedy(30, f"""
SELECT src_ip || ':' || CASE tcp_flags & 63 WHEN 0 THEN 'N' WHEN 1 THEN 'F' WHEN 41 THEN 'X' ELSE 'S' END AS k, ts, pkt_id,
  src_ip, dst_ip, {FLAG_TEXT} AS flags FROM packets
WHERE (tcp_flags & 63) IN (0, 1, 41, 32, 33) OR (tcp_flags & 3) = 3""", "ts, src_ip AS src, dst_ip AS dst, flags"))
def rule_stealth_decoded(spark, sf_dir):
    """The whole path: frames, decode, rule, cooldown."""
    alerts = rules.stealth_scan(decoded_packets(spark, sf_dir))
    return alerts.select("ts", "src", "dst", F.col("evidence")["flags"].alias("flags"))


@query("stats_decoded_http", "http_messages", sql="""
SELECT http_host AS host, method, count(*) AS packets FROM http_messages GROUP BY 1, 2""")
def stats_decoded_http(spark, sf_dir):
    flat = decode.flatten(decode.decode(http_frames(spark, sf_dir), LAYERS_HTTP))
    return flat.filter(F.col("http.kind") == "request").groupBy(
        F.col("http.headers")["host"].alias("host"), F.col("http.method").alias("method")).agg(F.count("*").alias("packets"))


@query("decode_links", "packets", sql="""
SELECT pkt_id, CASE pkt_id % 3 WHEN 0 THEN 'ARP' ELSE 'TCP' END AS protocol, src_ip, dst_ip, CAST(CASE WHEN pkt_id % 3 = 0 THEN 1 + pkt_id % 2 END AS INT) AS opcode,
  CASE WHEN pkt_id % 3 < 2 THEN 'aa:bb:cc:dd:ee:01' ELSE '00:00:00:00:00:00' END AS mac, CAST(CASE WHEN pkt_id % 3 = 0 THEN 2054 ELSE 2048 END AS INT) AS ethertype,
  CASE WHEN pkt_id % 3 > 0 THEN dst_port END AS dst_port FROM packets WHERE protocol = 'TCP'""")
def decode_links(spark, sf_dir):
    """ARP on Ethernet, and TCP behind Linux cooked and loopback headers."""
    p = packets(spark, sf_dir).filter("transport = 'TCP'")
    form = F.col("pkt_id") % 3
    arp = F.concat(F.lit("ffffffffffffaabbccddee010806" + "000108000604000"), (F.col("pkt_id") % 2 + 1).cast("string"), F.lit("aabbccddee01"),
                   _ip_hex(F.col("src_ip")), F.lit("000000000000"), _ip_hex(F.col("dst_ip")))
    ip = _ip_packet(F.lit(6), F.col("src_ip"), F.col("dst_ip"), _tcp(F.col("src_port"), F.col("dst_port"), F.col("pkt_id") % F.lit(2**32), F.col("tcp_flags"), F.lit("")))
    hexed = F.when(form == 0, arp).when(form == 1, F.concat(F.lit("000000010006aabbccddee0100000800"), ip)).otherwise(F.concat(F.lit("02000000"), ip))
    rows = decode.flatten(decode.decode(_frames(p, hexed, F.when(form == 0, 1).when(form == 1, 113).otherwise(0)), LAYERS_HEADERS))
    return rows.select("pkt_id", "protocol", "src_ip", "dst_ip", F.col("arp.opcode").alias("opcode"), F.col("eth.src").alias("mac"), "ethertype", "dst_port")


def _six(ip):
    return F.concat(F.lit("20010db8" + "0" * 16), _ip_hex(ip))


SIX = "'2001:db8::' || printf('%x', split_part({0}, '.', 1)::INT * 256 + split_part({0}, '.', 2)::INT) || ':' || printf('%x', split_part({0}, '.', 3)::INT * 256 + split_part({0}, '.', 4)::INT)"


@query("decode_ipv6", "packets", sql=f"""
SELECT pkt_id, {SIX.format('src_ip')} AS src_ip, {SIX.format('dst_ip')} AS dst_ip, CAST(6 AS INT) AS ip_version, CAST(40 + 8 * (pkt_id % 3) AS INT) AS header_length,
  src_port, dst_port, tcp_flags FROM packets WHERE protocol = 'TCP'""")
def decode_ipv6(spark, sf_dir):
    """TCP over IPv6 with no, one or two extension headers."""
    p = packets(spark, sf_dir).filter("transport = 'TCP'")
    tcp = _tcp(F.col("src_port"), F.col("dst_port"), F.col("pkt_id") % F.lit(2**32), F.col("tcp_flags"), F.lit(""))
    extra = (F.col("pkt_id") % 3).cast("int")
    headers = F.when(extra == 0, F.lit("")).when(extra == 1, F.lit("0600" + "0" * 12)).otherwise(F.lit("3c00" + "0" * 12 + "0600" + "0" * 12))
    hexed = F.concat(F.lit("60000000"), _hex(extra * 8 + 20, 4), F.when(extra == 0, F.lit("06")).otherwise(F.lit("00")), F.lit("40"),
                     _six(F.col("src_ip")), _six(F.col("dst_ip")), headers, tcp)
    rows = decode.decode(_frames(p, hexed, F.lit(101)), LAYERS_HEADERS)
    return rows.select("pkt_id", F.col("ip.src").alias("src_ip"), F.col("ip.dst").alias("dst_ip"), F.col("ip.version").alias("ip_version"),
                       F.col("ip.header_length").alias("header_length"), F.col("tcp.sport").alias("src_port"), F.col("tcp.dport").alias("dst_port"), F.col("tcp.flags").alias("tcp_flags"))


@query("decode_tcp_options", "packets", sql="""
SELECT pkt_id, 'mss=' || (500 + src_port % 2000) || ',wscale=' || (src_port % 15) || ',sack-permitted' AS options, CAST(32 AS INT) AS header_length, CAST(3 AS INT) AS payload_length
FROM packets WHERE protocol = 'TCP'""")
def decode_tcp_options(spark, sf_dir):
    p = packets(spark, sf_dir).filter("transport = 'TCP'")
    options = F.concat(F.lit("0204"), _hex(F.lit(500) + F.col("src_port") % 2000, 4), F.lit("01" + "0303"), _hex(F.col("src_port") % 15, 2), F.lit("0402" + "0100"))
    tcp = F.concat(_hex(F.col("src_port"), 4), _hex(F.col("dst_port"), 4), F.lit("0000000100000000" + "80"), _hex(F.col("tcp_flags"), 2), F.lit("0200beef0000"), options, F.lit("616263"))
    rows = decode.decode(_frames(p, F.concat(F.lit(ETHERNET), _ip_packet(F.lit(6), F.col("src_ip"), F.col("dst_ip"), tcp)), F.lit(1)), LAYERS_HEADERS)
    return rows.select("pkt_id", F.array_join("tcp.options", ",").alias("options"), F.col("tcp.header_length").alias("header_length"), F.col("tcp.payload_length").alias("payload_length"))


# type, data in hex (name pointers lead to the question's name) and what it says in SQL
ANSWERS = (
    (1, lambda: _ip_hex(F.col("dst_ip")), "dst_ip"), (28, lambda: _six(F.col("dst_ip")), SIX.format("dst_ip")), (5, lambda: F.lit("c00c"), "qname"),
    (15, lambda: F.lit("000ac00c"), "'10 ' || qname"), (16, lambda: F.lit("0568656c6c6f05776f726c64"), "'hello world'"),
    (33, lambda: F.lit("000100021f90c00c"), "qname || ':8080'"), (6, lambda: F.lit("c00cc00c" + "00000001" * 5), "'soa ' || qname"), (99, lambda: F.lit("deadbeef"), "'deadbeef'"),
)
_NTH = "CASE pkt_id % 8 " + " ".join(f"WHEN {i} THEN {{{i}}}" for i in range(8)) + " END"


@query("decode_dns_answers", "packets", sql=f"""
SELECT pkt_id, true AS is_response, CAST(pkt_id % 4 AS INT) AS rcode, qname AS name, CAST({_NTH.format(*[a[0] for a in ANSWERS])} AS INT) AS rtype, CAST(4000000000 + pkt_id % 1000 AS BIGINT) AS ttl,
  {_NTH.format(*[a[2] for a in ANSWERS])} AS data FROM packets WHERE protocol = 'UDP'""")
def decode_dns_answers(spark, sf_dir):
    """Responses with one answer of every type in turn."""
    p = packets(spark, sf_dir).filter("transport = 'UDP'")
    labels = F.array_join(F.transform(F.split("qname", r"\."), lambda x: F.concat(F.lpad(F.hex(F.length(x)), 2, "0"), F.hex(x))), "")
    which, kind, data = F.col("pkt_id") % 8, F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (number, made, _) in enumerate(ANSWERS):
        kind, data = F.when(which == i, F.lit(number)).otherwise(kind), F.when(which == i, made()).otherwise(data)
    message = F.concat(F.lit("0001818"), (F.col("pkt_id") % 4).cast("string"), F.lit("0001000100000000"), labels, F.lit("0000010001"), F.lit("c00c"), _hex(kind, 4), F.lit("0001"),
                       _hex(F.lit(4000000000) + F.col("pkt_id") % 1000, 8), _hex(F.length(data) / 2, 4), data)
    udp = F.concat(F.lit("0035"), _hex(F.col("src_port"), 4), _hex(F.length(message) / 2 + 8, 4), F.lit("0000"), message)
    rows = decode.decode(_frames(p, _ip_packet(F.lit(17), F.col("dst_ip"), F.col("src_ip"), udp), F.lit(101)), (*LAYERS_HEADERS, "dns"))
    return rows.select("pkt_id", "dns.is_response", "dns.rcode", F.explode("dns.answers").alias("a")).select(
        "pkt_id", "is_response", "rcode", "a.name", "a.rtype", "a.ttl", "a.data")
