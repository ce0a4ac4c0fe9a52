"""Queries over packets: statistics, predicates and packet rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import net as fnet
from ..functions.text import label_entropy
from ..operators import predicates as p
from ..operators import rules, stats
from .registry import greedy, query
from .views import view

# Comparison SQL fragments.
FLAG_TEXT = (
    "coalesce(nullif(concat_ws('|', " + ", ".join(
        f"CASE WHEN (tcp_flags & {bit}) <> 0 THEN '{name}' END"
        for name, bit in (("FIN", 1), ("SYN", 2), ("RST", 4), ("PSH", 8), ("ACK", 16), ("URG", 32), ("ECE", 64), ("CWR", 128))
    ) + "), ''), 'NONE')"
)
QTYPE_NAME = "CASE qtype WHEN 1 THEN 'A' WHEN 16 THEN 'TXT' ELSE CAST(qtype AS VARCHAR) END"
DOMAIN = "regexp_extract(qname, '([^.]+\\.[^.]+)$', 1)"


def packets(spark, sf_dir):
    """Packet rows with the transport named as the operators expect it."""
    return view(spark, sf_dir, "packets").withColumn("transport", F.col("protocol"))


def questions(spark, sf_dir):
    return view(spark, sf_dir, "packets").filter("qname IS NOT NULL")


def icmp(spark, sf_dir):
    return view(spark, sf_dir, "icmp_packets").withColumn("payload", F.unhex("payload_hex")).withColumn(
        "length", F.length("payload"))


def http(spark, sf_dir):
    """HTTP rows as the decoder shapes them: payload bytes and an ``http`` struct."""
    head = F.concat(
        F.col("method"), F.lit(" "), F.col("path"), F.lit(" HTTP/1.1\r\nHost: "), F.col("http_host"),
        F.coalesce(F.concat(F.lit("\r\nAuthorization: "), F.col("authorization")), F.lit("")),
        F.lit("\r\n\r\n"), F.col("body"),
    )
    headers = F.map_from_entries(F.filter(
        F.array(
            F.struct(F.lit("host").alias("key"), F.col("http_host").alias("value")),
            F.struct(F.lit("authorization").alias("key"), F.col("authorization").alias("value")),
        ),
        lambda e: e["value"].isNotNull(),
    ))
    return view(spark, sf_dir, "http_messages").select(
        "pkt_id", "ts", "src_ip", "dst_ip", F.lit(40000).alias("src_port"), "dst_port",
        F.lit(24).alias("tcp_flags"), F.lit("TCP").alias("transport"), F.encode(head, "ISO-8859-1").alias("payload"),
        F.struct("kind", "method", "path", headers.alias("headers"), F.length("body").alias("body_length")).alias("http"),
    )


# ---- statistics -------------------------------------------------------------------------

@query("stats_totals", "packets", sql="""
SELECT count(*) FILTER (length >= 100) AS packets, CAST(sum(length) FILTER (length >= 100) AS BIGINT) AS bytes,
  round(avg(length) FILTER (length >= 100), 6) AS average_size, CAST(0 AS BIGINT) AS decode_errors,
  count(*) FILTER (NOT length >= 100) AS filtered_out,
  round(max(ts) FILTER (length >= 100) - min(ts) FILTER (length >= 100), 6) AS duration FROM packets""")
def stats_totals(spark, sf_dir):
    out = stats.totals(packets(spark, sf_dir), p.length(">=", 100))
    return out.withColumn("average_size", F.round("average_size", 6)).withColumn("duration", F.round("duration", 6))


@query("stats_proto", "packets", sql="""
SELECT protocol, count(*) AS packets, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM packets GROUP BY protocol""")
def stats_proto(spark, sf_dir):
    return stats.by_protocol(packets(spark, sf_dir)).select("protocol", "packets", F.round("share", 6).alias("share"))


@query("stats_talkers_top", "packets", sql="""
SELECT src_ip, CAST(sum(length) AS BIGINT) AS bytes FROM packets GROUP BY src_ip ORDER BY 2 DESC, min(pkt_id) LIMIT 8""")
def stats_talkers_top(spark, sf_dir):
    return stats.top(stats.by_talker(packets(spark, sf_dir)), "bytes", 8).drop("first_seen")


@query("stats_conversations", "packets", sql="""
SELECT least(src_ip, dst_ip) || ' <-> ' || greatest(src_ip, dst_ip) AS conversation, CAST(sum(length) AS BIGINT) AS bytes
FROM packets GROUP BY 1""")
def stats_conversations(spark, sf_dir):
    return stats.by_conversation(packets(spark, sf_dir)).drop("first_seen")


@query("stats_dports", "packets", sql="""
SELECT protocol || '/' || dst_port AS port, count(*) AS packets FROM packets GROUP BY 1 ORDER BY 2 DESC, min(pkt_id) LIMIT 10""")
def stats_dports(spark, sf_dir):
    return stats.top(stats.by_destination_port(packets(spark, sf_dir)), "packets", 10).drop("first_seen")


@query("stats_flags", "packets", sql=f"""
SELECT {FLAG_TEXT} AS flags, count(*) AS packets FROM packets WHERE tcp_flags IS NOT NULL GROUP BY 1""")
def stats_flags(spark, sf_dir):
    return stats.by_flags(packets(spark, sf_dir)).drop("first_seen")


@query("stats_icmp", "icmp_packets", sql="""
SELECT CASE icmp_type WHEN 0 THEN 'echo-reply' WHEN 8 THEN 'echo-request' END AS icmp_type, count(*) AS packets
FROM icmp_packets GROUP BY 1""")
def stats_icmp(spark, sf_dir):
    return stats.by_icmp_type(icmp(spark, sf_dir)).drop("first_seen")


@query("stats_dns", "packets", sql=f"""
SELECT {QTYPE_NAME} || ' ' || qname AS query, count(*) AS packets FROM packets WHERE qname IS NOT NULL GROUP BY 1""")
def stats_dns(spark, sf_dir):
    return stats.by_dns_query(questions(spark, sf_dir)).drop("first_seen")


@query("stats_http_hosts", "http_messages", sql="""
SELECT http_host AS host, count(*) AS packets FROM http_messages WHERE kind = 'request' AND http_host <> '' GROUP BY 1""")
def stats_http_hosts(spark, sf_dir):
    return stats.by_http_host(http(spark, sf_dir)).drop("first_seen")


@query("stats_http_methods", "http_messages", sql="""
SELECT method, count(*) AS packets FROM http_messages WHERE kind = 'request' GROUP BY 1""")
def stats_http_methods(spark, sf_dir):
    return stats.by_http_method(http(spark, sf_dir)).drop("first_seen")


@query("stats_rate", "packets", sql="""
, recent AS (SELECT * FROM packets WHERE ts >= (SELECT max(ts) FROM packets) - 10)
SELECT round(count(*) / (max(ts) - min(ts)), 6) AS packets_per_second,
  round(sum(length) / (max(ts) - min(ts)), 6) AS bytes_per_second FROM recent""")
def stats_rate(spark, sf_dir):
    return stats.rate(packets(spark, sf_dir)).select(
        F.round("packets_per_second", 6).alias("packets_per_second"),
        F.round("bytes_per_second", 6).alias("bytes_per_second"))


@query("label_entropy", "packets", sql="""
, names AS (SELECT pkt_id, qname, split_part(qname, '.', 1) AS label FROM packets WHERE qname IS NOT NULL)
SELECT pkt_id, qname, round((SELECT entropy(c) FROM (SELECT unnest(string_split(label, '')) AS c)), 6) AS entropy FROM names""")
def label_entropy_query(spark, sf_dir):
    q = questions(spark, sf_dir)
    return q.select("pkt_id", "qname", F.round(label_entropy(F.split("qname", r"\.")[0]), 6).alias("entropy"))


# ---- predicates -------------------------------------------------------------------------

def _ids(df, condition):
    return df.filter(condition).select("pkt_id", "ts")


@query("pred_not_host", "packets", sql="""
SELECT pkt_id, ts FROM packets WHERE NOT (src_ip = '10.0.0.4' OR dst_ip = '10.0.0.4')""")
def pred_not_host(spark, sf_dir):
    return _ids(packets(spark, sf_dir), ~p.host("10.0.0.4"))


@query("pred_net", "packets", sql="""
SELECT pkt_id, ts FROM packets
WHERE regexp_matches(src_ip, '^203\\.0\\.113\\.[0-3]$') OR regexp_matches(dst_ip, '^203\\.0\\.113\\.[0-3]$')""")
def pred_net(spark, sf_dir):
    return _ids(packets(spark, sf_dir), p.net("203.0.113.1/30"))


@query("pred_port", "packets", sql="""
SELECT pkt_id, ts FROM packets WHERE dst_port = 4444 OR (protocol = 'UDP' AND src_port = 30007)""")
def pred_port(spark, sf_dir):
    return _ids(packets(spark, sf_dir), p.port(4444, "dst") | (p.proto("udp") & p.port(30007, "src")))


@query("pred_portrange", "packets", sql="""
SELECT pkt_id, ts FROM packets WHERE dst_port BETWEEN 50 AND 100 OR src_port BETWEEN 50 AND 100""")
def pred_portrange(spark, sf_dir):
    return _ids(packets(spark, sf_dir), p.portrange(50, 100))


@query("pred_flag", "packets", sql="""
SELECT pkt_id, ts FROM packets WHERE NOT coalesce((tcp_flags & 8) <> 0, false) AND coalesce((tcp_flags & 2) <> 0, false) = false""")
def pred_flag(spark, sf_dir):
    return _ids(packets(spark, sf_dir), ~p.tcp_flag("psh") & ~p.tcp_flag("Syn"))


@query("pred_length", "packets", sql="""
SELECT pkt_id, ts FROM packets WHERE length > 1000 AND length <> 1372""")
def pred_length(spark, sf_dir):
    return _ids(packets(spark, sf_dir), p.length(">", 1000) & p.length("!=", 1372))


@query("pred_payload", "http_messages", sql="""
SELECT pkt_id, ts FROM http_messages WHERE contains(lower(body), 'password=x1') OR contains(path, 'error')""")
def pred_payload(spark, sf_dir):
    return _ids(http(spark, sf_dir), p.payload_contains("PassWord=X1") | p.payload_contains("/ERROR"))


@query("private_addresses", "packets", sql="""
SELECT addr, addr LIKE '10.%' OR addr LIKE '192.168.%' AS internal, count(*) AS packets
FROM (SELECT src_ip AS addr FROM packets UNION ALL SELECT dst_ip FROM packets) GROUP BY 1""")
def private_addresses(spark, sf_dir):
    rows = packets(spark, sf_dir)
    ends = rows.select(F.col("src_ip").alias("addr")).union(rows.select("dst_ip"))
    return ends.groupBy("addr").agg(F.count("*").alias("packets")).withColumn(
        "internal", fnet.is_private(F.col("addr")))


@query("capture_first_packets", "packets", sql="""
SELECT pkt_id, ts FROM packets WHERE dst_port = 53 ORDER BY ts, pkt_id LIMIT 100""")
def capture_first_packets(spark, sf_dir):
    """Stop after so many matching packets."""
    return stats.packet_limit(packets(spark, sf_dir).filter(p.port(53, "dst")), 100).select("pkt_id", "ts")


@query("capture_first_seconds", "packets", sql="""
SELECT protocol, count(*) AS packets FROM packets WHERE ts < (SELECT min(ts) FROM packets) + 120 GROUP BY protocol""")
def capture_first_seconds(spark, sf_dir):
    rows = p.first_seconds(packets(spark, sf_dir), 120)
    return rows.groupBy("protocol").agg(F.count("*").alias("packets"))


@query("pred_whitelist", "packets", "blocklist", sql="""
SELECT src_ip, count(*) AS packets FROM packets WHERE src_ip NOT IN (SELECT ip FROM blocklist) AND ts >= (SELECT max(ts) FROM packets) - 300
GROUP BY src_ip""")
def pred_whitelist(spark, sf_dir):
    rows = packets(spark, sf_dir)
    recent = rows.filter(p.since(300, rows.agg(F.max("ts")).scalar()))
    return p.not_whitelisted(recent, view(spark, sf_dir, "blocklist")).groupBy("src_ip").agg(F.count("*").alias("packets"))


# ---- rules ------------------------------------------------------------------------------

def _picked(alerts, *evidence, keep=("src", "dst")):
    """Alert columns in plain types: evidence numbers are cast, text is left alone."""
    casts = [F.col("evidence")[name].cast(kind).alias(name) for name, kind in evidence]
    return alerts.select("ts", "severity", "rule", *keep, *casts)


@query("rule_stealth", "packets", sql=greedy(30, """
SELECT src_ip || ':' || CASE tcp_flags & 63 WHEN 0 THEN 'N' WHEN 1 THEN 'F' WHEN 41 THEN 'X' ELSE 'S' END AS k, ts, pkt_id,
  src_ip, dst_ip, dst_port, """ + FLAG_TEXT + """ AS flags FROM packets
WHERE (tcp_flags & 63) IN (0, 1, 41, 32, 33) OR (tcp_flags & 3) = 3""",
    "ts, 'high' AS severity, 'stealth-scan' AS rule, src_ip AS src, dst_ip AS dst, flags, dst_port AS dport"))
def rule_stealth(spark, sf_dir):
    return _picked(rules.stealth_scan(packets(spark, sf_dir)), ("flags", "string"), ("dport", "int"))


@query("rule_port_scan", "packets", sql=greedy(30, """
SELECT * FROM (SELECT src_ip || '>' || dst_ip AS k, ts, pkt_id, src_ip, dst_ip,
  count(DISTINCT dst_port) OVER w AS n, list(dst_port) OVER w AS ports
FROM packets WHERE tcp_flags = 2
WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY ts RANGE BETWEEN 10 PRECEDING AND CURRENT ROW)) WHERE n >= 20""",
    """ts, 'high' AS severity, 'port-scan' AS rule, src_ip AS src, dst_ip AS dst, n AS distinct_ports,
  '[' || array_to_string(list_sort(list_distinct(ports))[1:15], ',') || ']' AS sample_ports"""))
def rule_port_scan(spark, sf_dir):
    return _picked(rules.port_scan(packets(spark, sf_dir)), ("distinct_ports", "long"), ("sample_ports", "string"))


@query("rule_host_sweep", "packets", sql=greedy(30, """
SELECT * FROM (SELECT src_ip AS k, ts, pkt_id, src_ip, count(DISTINCT dst_ip) OVER (
  PARTITION BY src_ip ORDER BY ts RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS n
FROM packets WHERE tcp_flags = 2) WHERE n >= 15""",
    "ts, 'medium' AS severity, 'host-sweep' AS rule, src_ip AS src, n AS hosts"))
def rule_host_sweep(spark, sf_dir):
    return _picked(rules.host_sweep(packets(spark, sf_dir)), ("hosts", "long"), keep=("src",))


@query("rule_ping_sweep", "icmp_packets", sql=greedy(30, """
SELECT * FROM (SELECT src_ip AS k, ts, pkt_id, src_ip, count(DISTINCT dst_ip) OVER (
  PARTITION BY src_ip ORDER BY ts RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS n
FROM icmp_packets WHERE icmp_type IN (8, 128)) WHERE n >= 15""",
    "ts, 'medium' AS severity, 'ping-sweep' AS rule, src_ip AS src, n AS hosts"))
def rule_ping_sweep(spark, sf_dir):
    return _picked(rules.ping_sweep(icmp(spark, sf_dir)), ("hosts", "long"), keep=("src",))


@query("rule_syn_flood", "packets", sql=greedy(30, """
SELECT * FROM (SELECT dst_ip || ':' || dst_port AS k, ts, pkt_id, dst_ip, dst_port, count(*) OVER (
  PARTITION BY dst_ip, dst_port ORDER BY ts RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n
FROM packets WHERE tcp_flags = 2) WHERE n >= 120""",
    "ts, 'high' AS severity, 'syn-flood' AS rule, dst_ip AS dst, n AS syn_count, dst_port AS port"))
def rule_syn_flood(spark, sf_dir):
    return _picked(rules.syn_flood(packets(spark, sf_dir)), ("syn_count", "long"), ("port", "int"), keep=("dst",))


@query("rule_dns_tunnel", "packets", sql=greedy(30, f"""
SELECT * FROM (SELECT src_ip || ':' || {DOMAIN} AS k, ts, pkt_id, src_ip, dst_ip, qname, {QTYPE_NAME} AS qtype,
  list_max(list_transform(string_split(qname, '.'), lambda x: length(x))) AS label_length,
  (SELECT entropy(c) FROM (SELECT unnest(string_split(split_part(qname, '.', 1), '')) AS c)) AS h
FROM packets WHERE qname IS NOT NULL) WHERE label_length >= 45 AND h >= 3.6""",
    """ts, 'high' AS severity, 'dns-tunnel' AS rule, src_ip AS src, dst_ip AS dst, qname,
  CAST(label_length AS BIGINT) AS label_length, round(h, 2) AS entropy, qtype"""))
def rule_dns_tunnel(spark, sf_dir):
    return _picked(rules.dns_tunnel(questions(spark, sf_dir)), ("qname", "string"), ("label_length", "long"),
                   ("entropy", "double"), ("qtype", "string"))


@query("rule_dns_volume", "packets", sql=greedy(30, f"""
SELECT * FROM (SELECT src_ip || ':' || {DOMAIN} AS k, ts, pkt_id, src_ip, {DOMAIN} AS domain, count(DISTINCT qname) OVER (
  PARTITION BY src_ip, {DOMAIN} ORDER BY ts RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS n
FROM packets WHERE qname IS NOT NULL) WHERE n >= 30""",
    "ts, 'high' AS severity, 'dns-tunnel-volume' AS rule, src_ip AS src, domain, n AS unique_subdomains"))
def rule_dns_volume(spark, sf_dir):
    return _picked(rules.dns_volume(questions(spark, sf_dir)), ("domain", "string"),
                   ("unique_subdomains", "long"), keep=("src",))


@query("rule_dns_rare", "packets", sql=greedy(30, f"""
SELECT src_ip || ':' || {QTYPE_NAME} AS k, ts, pkt_id, src_ip, qname, {QTYPE_NAME} AS qtype
FROM packets WHERE qtype IN (10, 16, 255)""",
    "ts, 'low' AS severity, 'dns-rare-qtype' AS rule, src_ip AS src, qtype, qname"))
def rule_dns_rare(spark, sf_dir):
    return _picked(rules.dns_rare(questions(spark, sf_dir)), ("qtype", "string"), ("qname", "string"), keep=("src",))


@query("rule_icmp_tunnel", "icmp_packets", sql=greedy(30, """
SELECT * FROM (SELECT src_ip || '>' || dst_ip AS k, ts, pkt_id, src_ip, dst_ip, length(payload_hex) // 2 AS n,
  (SELECT entropy(substr(payload_hex, CAST(i AS INT), 2)) FROM (SELECT unnest(range(1, length(payload_hex) + 1, 2)) AS i)) AS h
FROM icmp_packets WHERE icmp_type IN (0, 8, 128, 129) AND length(payload_hex) >= 256) WHERE h >= 6.0""",
    """ts, 'high' AS severity, 'icmp-tunnel' AS rule, src_ip AS src, dst_ip AS dst,
  CAST(n AS BIGINT) AS payload_bytes, round(h, 2) AS entropy"""))
def rule_icmp_tunnel(spark, sf_dir):
    return _picked(rules.icmp_tunnel(icmp(spark, sf_dir)), ("payload_bytes", "long"), ("entropy", "double"))


@query("rule_credentials_basic", "http_messages", sql=greedy(30, """
SELECT src_ip AS k, ts, pkt_id, src_ip, dst_ip, path FROM http_messages WHERE lower("authorization") LIKE 'basic %'""",
    "ts, 'high' AS severity, 'cleartext-credentials' AS rule, src_ip AS src, dst_ip AS dst, path"))
def rule_credentials_basic(spark, sf_dir):
    return _picked(rules.basic_credentials(http(spark, sf_dir)), ("path", "string"))


@query("rule_credentials_form", "http_messages", sql=greedy(30, """
SELECT src_ip AS k, ts, pkt_id, src_ip, dst_ip, path, 'password' AS field FROM http_messages
WHERE body LIKE '%password=_%'""",
    "ts, 'high' AS severity, 'cleartext-credentials' AS rule, src_ip AS src, dst_ip AS dst, field, path"))
def rule_credentials_form(spark, sf_dir):
    return _picked(rules.form_credentials(http(spark, sf_dir)), ("field", "string"), ("path", "string"))


LOGINS = """
SELECT event_id AS pkt_id, ts, src_ip, '192.168.1.10' AS dst_ip, CAST(CASE WHEN event_id%2=0 THEN 40000 ELSE 110 END AS INT) AS src_port,
  CAST(CASE event_id%4 WHEN 0 THEN 21 WHEN 1 THEN 50001 WHEN 2 THEN 143 ELSE 23 END AS INT) AS dst_port,
  CASE WHEN event_id%3=0 THEN concat('user ', username) WHEN event_id%3=1 THEN concat('PASS s', username) ELSE 'NOOP' END AS text FROM auth_events"""


@query("rule_credentials_login", "auth_events", sql=greedy(30, f"""
SELECT src_ip || ':' || port AS k, ts, pkt_id, src_ip, dst_ip,
  CASE port WHEN 21 THEN 'FTP' WHEN 23 THEN 'telnet' WHEN 110 THEN 'POP3' ELSE 'IMAP' END AS protocol,
  upper(substr(text, 1, 4)) AS command
FROM (SELECT *, CASE WHEN dst_port IN (21, 23, 110, 143) THEN dst_port ELSE src_port END AS port FROM ({LOGINS}))
WHERE port IN (21, 23, 110, 143) AND text <> 'NOOP'""",
    "ts, 'high' AS severity, 'cleartext-credentials' AS rule, src_ip AS src, dst_ip AS dst, protocol, command"))
def rule_credentials_login(spark, sf_dir):
    rows = spark.sql(LOGINS.replace("FROM auth_events", "FROM {a}"), a=view(spark, sf_dir, "auth_events"))
    shaped = rows.withColumn("payload", F.encode(F.concat(F.lit("220 x\r\n"), "text", F.lit("\r\n")), "UTF-8"))
    return _picked(rules.login_credentials(shaped.withColumn("tcp_flags", F.lit(24))),
                   ("protocol", "string"), ("command", "string"))


@query("rule_suspicious_port", "packets", sql=""",
lists AS (SELECT src_ip, dst_ip, list({'ts': ts, 'id': pkt_id, 'd': dst_port, 's': src_port,
  'd23': -1e18::DOUBLE, 'd4444': -1e18::DOUBLE, 's31337': -1e18::DOUBLE, 'port': CAST(NULL AS INT), 'out': CAST([] AS STRUCT(ts DOUBLE, port INT)[])} ORDER BY ts, pkt_id) AS l
  FROM (SELECT src_ip, dst_ip, ts, pkt_id, dst_port, src_port FROM packets
        WHERE dst_port IN (23, 4444) OR src_port = 31337) GROUP BY src_ip, dst_ip),
folded AS (SELECT src_ip, dst_ip, list_reduce(list_prepend({'ts': -1e18::DOUBLE, 'id': 0::BIGINT, 'd': 0::INT, 's': 0::INT,
  'd23': -1e18::DOUBLE, 'd4444': -1e18::DOUBLE, 's31337': -1e18::DOUBLE, 'port': CAST(NULL AS INT), 'out': CAST([] AS STRUCT(ts DOUBLE, port INT)[])}, l),
  lambda a, x: CASE
    WHEN x.d = 23 AND x.ts - a.d23 >= 30 THEN {'ts': x.ts, 'id': x.id, 'd': x.d, 's': x.s, 'd23': x.ts, 'd4444': a.d4444, 's31337': a.s31337,
      'port': 23::INT, 'out': list_append(a.out, {'ts': x.ts, 'port': 23::INT})}
    WHEN x.d = 4444 AND x.ts - a.d4444 >= 30 THEN {'ts': x.ts, 'id': x.id, 'd': x.d, 's': x.s, 'd23': a.d23, 'd4444': x.ts, 's31337': a.s31337,
      'port': 4444::INT, 'out': list_append(a.out, {'ts': x.ts, 'port': 4444::INT})}
    WHEN x.s = 31337 AND x.ts - a.s31337 >= 30 THEN {'ts': x.ts, 'id': x.id, 'd': x.d, 's': x.s, 'd23': a.d23, 'd4444': a.d4444, 's31337': x.ts,
      'port': 31337::INT, 'out': list_append(a.out, {'ts': x.ts, 'port': 31337::INT})}
    ELSE {'ts': x.ts, 'id': x.id, 'd': x.d, 's': x.s, 'd23': a.d23, 'd4444': a.d4444, 's31337': a.s31337, 'port': CAST(NULL AS INT), 'out': a.out} END) AS r
  FROM lists)
SELECT f.ts, 'medium' AS severity, 'suspicious-port' AS rule, src_ip AS src, dst_ip AS dst, f.port AS port
FROM (SELECT src_ip, dst_ip, unnest(r.out) AS f FROM folded)""")
def rule_suspicious_port(spark, sf_dir):
    return _picked(rules.suspicious_port(packets(spark, sf_dir)), ("port", "int"))


@query("rule_egress", "packets", sql=greedy(30, """
SELECT * FROM (SELECT src_ip || '>' || dst_ip AS k, ts, pkt_id, src_ip, dst_ip, sum(length) OVER (
  PARTITION BY src_ip, dst_ip ORDER BY ts RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS n
FROM packets WHERE src_ip LIKE '10.%' AND dst_ip NOT LIKE '192.168.%') WHERE n >= 500000""",
    "ts, 'medium' AS severity, 'data-egress' AS rule, src_ip AS src, dst_ip AS dst, CAST(n AS BIGINT) AS bytes"))
def rule_egress(spark, sf_dir):
    return _picked(rules.data_egress(packets(spark, sf_dir), limit=500000), ("bytes", "long"))
