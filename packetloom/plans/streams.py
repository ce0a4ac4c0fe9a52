"""Streaming queries replayed over the given tables; the SQL states what must have come out.

A replay stores the rows in stretches of time, each written and read by as many tasks as it has work for, and streams a stretch
a micro-batch.  The stream stops after each and goes on from the checkpoint, so state is carried over batches and restarts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as packet_rules
from ..operators.rules import syn_only
from ..session import materialize, new_folder
from ..sources import authlog
from ..streaming import held, rules, windows
from ..streaming import monitor as live
from ..streaming.store import Kept, whole
from .monitoring import packets as monitor_packets
from .registry import greedy, query
from .traffic import DOMAIN, icmp, packets, questions
from .views import view

STRETCHES = 6


def _batches(df, ts="ts", closing=False):
    """Rows of one table cut into ``STRETCHES`` stretches of time; ``closing`` adds a copy of the newest row a day later, whose
    time lets the watermark pass everything before it."""
    rows = materialize(df)
    low, high = rows.agg(F.min(ts), F.max(ts)).first()
    if low is None:
        return
    step = (high - low) / (STRETCHES - closing) + 1e-6
    part = F.floor((F.col(ts) - low) / step)
    for k in range(STRETCHES - closing):
        yield rows.filter(part == k)
    if closing:
        yield rows.orderBy(F.desc(ts)).limit(1).withColumn(ts, F.col(ts) + 86400.0)


def replay(df, build, start=None, closing=False):
    """Stream rows through ``build`` and return what arrived: in Parquet, or where ``start(stream, root)`` writes it."""
    spark = df.sparkSession
    root = new_folder(spark)

    def run():
        stream = windows.with_event_time(spark.readStream.schema(df.schema).parquet(f"{root}/in"))
        out = build(stream)
        writer = out.writeStream.format("parquet").option("path", f"{root}/out").outputMode("append") if start is None else start(out, root)
        writer.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
        return out.schema

    schema = None
    for rows in _batches(df, closing=closing):
        rows.write.mode("append").parquet(f"{root}/in")  # a run takes all files that are new: this stretch
        schema = run()
    schema = schema or run()
    return spark.read.schema(schema).parquet(f"{root}/out") if start is None else root


def alerts_of(df, rule, quiet):
    """The alerts of a trailing rule over a replayed table."""
    root = replay(df, lambda s: held.whole_slices(s, rule), closing=True, start=lambda out, root: out.writeStream.foreachBatch(
        held.alert_sink(root, rule, quiet)))
    return whole(df.sparkSession, root, "alerts", "ts double, pkt_id bigint, src string, dst string, severity string, rule string, evidence map<string,string>")


@query("stream_alerts_5min", "alerts", sql="""
SELECT CAST(floor(ts / 300) AS BIGINT) * 300000 AS time, kind, count(*) AS total FROM alerts
WHERE (floor(ts / 300) + 1) * 300 <= (SELECT max(ts) FROM alerts) - 60 GROUP BY 1, 2""")
def stream_alerts_5min(spark, sf_dir):
    return replay(view(spark, sf_dir, "alerts").select("ts", "kind"), windows.alerts_per_bucket)


@query("stream_traffic_windows", "packets", sql="""
SELECT floor(ts / 60) * 60 AS window_start, (floor(ts / 60) + 1) * 60 AS window_end, count(*) AS packet_count,
  CAST(sum(length) AS BIGINT) AS byte_count, count(DISTINCT src_ip) AS unique_sources FROM packets
WHERE (floor(ts / 60) + 1) * 60 <= (SELECT max(ts) FROM packets) - 60 GROUP BY 1, 2""")
def stream_traffic_windows(spark, sf_dir):
    return replay(monitor_packets(spark, sf_dir).select("ts", "src_ip", "length"), windows.traffic_windows)


@query("stream_port_scan", "packets", sql=greedy(30, """
SELECT * FROM (SELECT src_ip || '>' || dst_ip AS k, ts, pkt_id, src_ip, dst_ip, count(DISTINCT dst_port) OVER (
  PARTITION BY src_ip, dst_ip ORDER BY ts RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS n
FROM packets WHERE tcp_flags = 2) WHERE n >= 20""", "ts, src_ip, dst_ip, n"))
def stream_port_scan(spark, sf_dir):
    rows = syn_only(packets(spark, sf_dir)).select("pkt_id", "ts", "src_ip", "dst_ip", "dst_port")
    out = replay(rows, lambda s: rules.trailing_distinct_alerts(s, ["src_ip", "dst_ip"], "dst_port", 10.0, 20, 30.0))
    return out.select("ts", "src_ip", "dst_ip", "n")


@query("stream_suppress", "alerts", sql=greedy(300, """
SELECT kind || '/' || coalesce(src_ip, '-') AS k, ts, id AS pkt_id, id, kind, src_ip FROM alerts""", "id, ts, kind, src_ip"))
def stream_suppress(spark, sf_dir):
    rows = view(spark, sf_dir, "alerts").select("id", "ts", "kind", "src_ip")
    return replay(rows, lambda s: rules.cooldown(s, ["kind", "src_ip"], 300.0, seq="id"))


@query("stream_port_scan_windows", "packets", sql="""
, slots AS (SELECT p.*, unnest(range(CAST(floor(ts / 15) AS BIGINT) + 1, CAST(floor(ts / 15) AS BIGINT) + 5)) AS c FROM packets p)
SELECT CAST(c * 15 AS DOUBLE) AS ts, src_ip, count(DISTINCT dst_port) AS ports, CAST(count(*) AS BIGINT) AS packets,
  CAST(count(*) FILTER (tcp_flags IN (2, 3)) AS BIGINT) AS syns FROM slots
WHERE c * 15 <= (SELECT max(ts) FROM packets) - 60 GROUP BY c, src_ip HAVING count(DISTINCT dst_port) >= 15""")
def stream_port_scan_windows(spark, sf_dir):
    rows = monitor_packets(spark, sf_dir).select("ts", "src_ip", "dst_port", "flags")
    return replay(rows, windows.port_scan_windows)


@query("stream_brute_force_windows", "auth_events", sql="""
, slots AS (SELECT a.*, unnest(range(CAST(floor(ts / 15) AS BIGINT) + 1, CAST(floor(ts / 15) AS BIGINT) + 21)) AS c FROM auth_events a WHERE NOT success)
SELECT CAST(c * 15 AS DOUBLE) AS ts, src_ip, CAST(count(*) AS BIGINT) AS failures, count(DISTINCT username) AS users FROM slots
WHERE c * 15 <= (SELECT max(ts) FROM auth_events WHERE NOT success) - 60 GROUP BY c, src_ip HAVING count(*) >= 8""")
def stream_brute_force_windows(spark, sf_dir):
    # The watermark follows the failures: Spark filters before it takes the newest time.
    rows = view(spark, sf_dir, "auth_events").select("ts", "src_ip", "username", "success")
    return replay(rows, windows.brute_force_windows)


# ---- rules that hold rows back until their time is complete ------------------------------------

@query("stream_syn_flood", "packets", sql=greedy(30, """
SELECT * FROM (SELECT dst_ip || ':' || dst_port AS k, ts, pkt_id, dst_ip, dst_port, count(*) OVER (
  PARTITION BY dst_ip, dst_port ORDER BY ts RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n
FROM packets WHERE tcp_flags = 2) WHERE n >= 120""", "ts, dst_ip, CAST(dst_port AS VARCHAR) AS port, CAST(n AS VARCHAR) AS n"))
def stream_syn_flood(spark, sf_dir):
    rows = syn_only(packets(spark, sf_dir)).select("pkt_id", "ts", "dst_ip", "dst_port", "tcp_flags")
    out = alerts_of(rows, packet_rules.syn_flood_rule(), 30.0)
    return out.select("ts", F.col("dst").alias("dst_ip"), F.col("evidence")["port"].alias("port"), F.col("evidence")["syn_count"].alias("n"))


@query("stream_egress", "packets", sql=greedy(30, """
SELECT * FROM (SELECT src_ip || '>' || dst_ip AS k, ts, pkt_id, src_ip, dst_ip, CAST(sum(length) OVER (
  PARTITION BY src_ip, dst_ip ORDER BY ts RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS BIGINT) AS bytes
FROM packets WHERE src_ip LIKE '10.%' AND dst_ip = '198.51.100.77') WHERE bytes >= 20000""", "ts, src_ip, dst_ip, CAST(bytes AS VARCHAR) AS bytes"))
def stream_egress(spark, sf_dir):
    # 198.51.100.77 is the one destination of the view that is not private
    rows = packets(spark, sf_dir).filter("src_ip LIKE '10.%' AND dst_ip = '198.51.100.77'").select("pkt_id", "ts", "src_ip", "dst_ip", "length")
    rule = packet_rules.data_egress_rule(limit=20000)
    external = packet_rules.Trailing(lambda df: df, rule.keys, rule.span, rule.least, rule.alerts, amount=rule.amount, out=rule.out)
    out = alerts_of(rows, external, 30.0)
    return out.select("ts", F.col("src").alias("src_ip"), F.col("dst").alias("dst_ip"), F.col("evidence")["bytes"].alias("bytes"))


@query("stream_host_sweep", "packets", sql=greedy(30, """
SELECT * FROM (SELECT src_ip AS k, ts, pkt_id, src_ip, count(DISTINCT dst_ip) OVER (
  PARTITION BY src_ip ORDER BY ts RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS n
FROM packets WHERE tcp_flags = 2) WHERE n >= 15""", "ts, src_ip, CAST(n AS VARCHAR) AS n"))
def stream_host_sweep(spark, sf_dir):
    rows = syn_only(packets(spark, sf_dir)).select("pkt_id", "ts", "src_ip", "dst_ip", "dst_port", "tcp_flags")
    out = alerts_of(rows, packet_rules.host_sweep_rule(), 30.0)
    return out.select("ts", F.col("src").alias("src_ip"), F.col("evidence")["hosts"].alias("n"))


@query("stream_ping_sweep", "icmp_packets", sql=greedy(30, """
SELECT * FROM (SELECT src_ip AS k, ts, pkt_id, src_ip, count(DISTINCT dst_ip) OVER (
  PARTITION BY src_ip ORDER BY ts RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS n
FROM icmp_packets WHERE icmp_type = 8) WHERE n >= 11""", "ts, src_ip, CAST(n AS VARCHAR) AS n"))
def stream_ping_sweep(spark, sf_dir):
    rows = icmp(spark, sf_dir).filter("icmp_type = 8").select("pkt_id", "ts", "src_ip", "dst_ip", "icmp_type")
    out = alerts_of(rows, packet_rules.ping_sweep_rule(hosts=11), 30.0)
    return out.select("ts", F.col("src").alias("src_ip"), F.col("evidence")["hosts"].alias("n"))


@query("stream_dns_volume", "packets", sql=greedy(30, f"""
SELECT * FROM (SELECT src_ip || '/' || domain AS k, ts, pkt_id, src_ip, domain, count(DISTINCT qname) OVER (
  PARTITION BY src_ip, domain ORDER BY ts RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS n
FROM (SELECT *, {DOMAIN} AS domain FROM packets WHERE qname IS NOT NULL)) WHERE n >= 30""", "ts, src_ip, domain, CAST(n AS VARCHAR) AS n"))
def stream_dns_volume(spark, sf_dir):
    rows = questions(spark, sf_dir).select("pkt_id", "ts", "src_ip", "qname")
    out = alerts_of(rows, packet_rules.dns_volume_rule(), 30.0)
    return out.select("ts", F.col("src").alias("src_ip"), F.col("evidence")["domain"].alias("domain"), F.col("evidence")["unique_subdomains"].alias("n"))


@query("stream_port_scan_held", "packets", sql=greedy(30, """
SELECT * FROM (SELECT src_ip || '>' || dst_ip AS k, ts, pkt_id, src_ip, dst_ip,
  list_sort(list_distinct(list(dst_port) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts RANGE BETWEEN 10 PRECEDING AND CURRENT ROW))) AS ports
FROM packets WHERE tcp_flags = 2) WHERE len(ports) >= 20""", "ts, src_ip, dst_ip, CAST(len(ports) AS VARCHAR) AS n, replace(CAST(ports[1:15] AS VARCHAR), ' ', '') AS sample_ports"))
def stream_port_scan_held(spark, sf_dir):
    rows = syn_only(packets(spark, sf_dir)).select("pkt_id", "ts", "src_ip", "dst_ip", "dst_port", "tcp_flags")
    out = alerts_of(rows, packet_rules.port_scan_rule(), 30.0)
    return out.select("ts", F.col("src").alias("src_ip"), F.col("dst").alias("dst_ip"), F.col("evidence")["distinct_ports"].alias("n"),
                      F.col("evidence")["sample_ports"].alias("sample_ports"))


@query("stream_suppress_held", "alerts", sql=greedy(300, """
SELECT kind || '/' || coalesce(src_ip, '-') AS k, ts, id AS pkt_id, id, kind, src_ip FROM alerts""", "id, ts, kind, src_ip"))
def stream_suppress_held(spark, sf_dir):
    rows = view(spark, sf_dir, "alerts").select("id", "ts", "kind", "src_ip")
    root = replay(rows, held.held_rows, closing=True, start=lambda out, root: out.writeStream.foreachBatch(
        held.cooldown_sink(root, ["kind", "src_ip"], 300.0, seq="id")))
    return whole(spark, root, "fired", "id bigint, ts double, kind string, src_ip string").select("id", "ts", "kind", "src_ip")


# ---- live totals ---------------------------------------------------------------------------------

@query("stream_totals", "packets", sql="""
SELECT protocol, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM packets GROUP BY protocol""")
def stream_totals(spark, sf_dir):
    rows = packets(spark, sf_dir).select("ts", "protocol", "length")
    root = replay(rows, windows.running_totals, start=lambda out, root: out.writeStream.outputMode("update").foreachBatch(
        windows.totals_sink(root)))
    return Kept(spark, f"{root}/totals", ["protocol"], windows.TOTALS).before(1 << 62)


# ---- a growing log -----------------------------------------------------------------------------------

def _grow(lines, folder, upto):
    """Write every host's log anew with its lines up to a time: one task a host, the same again if it is repeated."""
    def write(batches):
        from pyarrow import fs
        import pyarrow as pa
        system = fs.LocalFileSystem()
        held = {}
        for batch in batches:
            for host, stamp, line in zip(*(batch.column(c).to_pylist() for c in ("host", "ts", "line"))):
                held.setdefault(host, []).append(f"{stamp:.0f} {line}\n")
        for host, text in held.items():
            with system.open_output_stream(f"{folder}/auth-{host}.log") as out:
                out.write("".join(text).encode())
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64())], ["host"])

    part = lines.filter(F.col("ts") <= upto).repartition(HOSTS, "host").sortWithinPartitions("host", "ts")
    part.mapInArrow(write, "host bigint").collect()


HOSTS = 4


@query("stream_auth_tail", "auth_lines", "auth_events", sql="""
SELECT a.ts, a.src_ip, a.username, a.success, count(*) AS n FROM auth_lines l JOIN auth_events a USING (event_id) GROUP BY ALL""")
def stream_auth_tail(spark, sf_dir):
    """Log files that grow between micro-batches; the stream stops and goes on from its checkpoint each time."""
    lines = materialize(view(spark, sf_dir, "auth_lines").select((F.col("event_id") % HOSTS).alias("host"), "ts", "line"))
    root = new_folder(spark)
    folder = root.removeprefix("file://") + "/logs"
    spark.range(1).write.parquet(f"{root}/logs/new")  # makes the folder where Spark can reach it
    low, high = lines.agg(F.min("ts"), F.max("ts")).first()
    for k in range(1, 5 + 1):
        _grow(lines, folder, low + (high - low) * k / 5)
        stream = authlog.stream(spark, f"file://{folder}/auth-*.log", F.substring_index("line", " ", 1).cast("double"))
        (stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
         .trigger(availableNow=True).start().awaitTermination())
    rows = spark.read.schema(stream.schema).parquet(f"{root}/out")
    return rows.groupBy("ts", "src_ip", "username", "success").agg(F.count("*").alias("n"))


# ---- the monitor -----------------------------------------------------------------------------------

_CYCLES = """
, seen AS (SELECT ts, src_ip FROM packets UNION ALL SELECT ts, src_ip FROM auth_events),
span AS (SELECT CAST(ceil(min(ts) / 15) AS BIGINT) AS low, CAST(ceil(max(ts) / 15) AS BIGINT) - 1 AS high FROM seen),
copies AS (SELECT p.*, unnest(range(CAST(ceil(ts / 15) AS BIGINT), CAST(floor((ts + 60) / 15) AS BIGINT) + 1)) AS c FROM packets p),
pc AS (SELECT copies.* FROM copies, span WHERE c BETWEEN low AND high),
tries AS (SELECT a.*, unnest(range(CAST(ceil(ts / 15) AS BIGINT), CAST(floor((ts + 300) / 15) AS BIGINT) + 1)) AS c FROM auth_events a WHERE NOT success),
scans AS (SELECT c, src_ip, count(DISTINCT dst_port) AS n FROM pc WHERE dst_port IS NOT NULL AND src_ip NOT IN ('127.0.0.1', '10.0.0.1')
  GROUP BY c, src_ip HAVING count(DISTINCT dst_port) >= 15),
brute AS (SELECT c, src_ip, count(*) AS n FROM tries, span WHERE c BETWEEN low AND high AND src_ip NOT IN ('127.0.0.1', '10.0.0.1') GROUP BY c, src_ip HAVING count(*) >= 8),
grid AS (SELECT unnest(range(low, high + 1)) AS c FROM span),
counts AS (SELECT c, src_ip, count(*) AS n FROM pc GROUP BY c, src_ip),
series AS (SELECT g.c, coalesce(sum(n), 0) AS n, arg_max(src_ip, {'n': n, 's': src_ip}) AS src_ip FROM grid g LEFT JOIN counts k ON k.c = g.c GROUP BY g.c),
base AS (SELECT *, avg(n) OVER b AS mean, stddev_pop(n) OVER b AS dev, count(*) OVER b AS k FROM series WINDOW b AS (ORDER BY c ROWS BETWEEN 14 PRECEDING AND 5 PRECEDING)),
spikes AS (SELECT c, src_ip, n FROM base WHERE k >= 3 AND n >= 50 AND n > mean + 3.0 * CASE WHEN dev = 0 THEN 1.0 ELSE dev END),
listed AS (SELECT DISTINCT c, src_ip FROM (SELECT src_ip, unnest(range(CAST(ceil(ts / 15) AS BIGINT), CAST(floor((ts + 900) / 15) AS BIGINT) + 1)) AS c FROM seen
  WHERE src_ip IN (SELECT ip FROM blocklist)), span WHERE c BETWEEN low AND high),
given AS (SELECT c, src_ip, 40 AS points FROM scans UNION ALL SELECT c, src_ip, 50 FROM brute
  UNION ALL SELECT c, src_ip, 20 FROM spikes WHERE src_ip NOT IN ('127.0.0.1', '10.0.0.1') UNION ALL SELECT c, src_ip, 60 FROM listed),
scores AS (SELECT c, src_ip, least(100, sum(sum(points)) OVER (PARTITION BY src_ip ORDER BY c)) AS score, lead(c) OVER (PARTITION BY src_ip ORDER BY c) AS after FROM given GROUP BY c, src_ip),
suspects AS (SELECT unnest(range(c, least(c + 60, coalesce(after - 1, high), high) + 1)) AS c, src_ip, score FROM scores, span WHERE score >= 50)
"""


@query("mon_cycle", "packets", "auth_events", "blocklist", sql=_CYCLES + greedy(300, """
SELECT kind || '/' || coalesce(src_ip, '-') AS k, CAST(c * 15 AS DOUBLE) AS ts, 0 AS pkt_id, kind, severity, src_ip, CAST(score AS BIGINT) AS score FROM (
  SELECT c, 'port_scan' AS kind, CASE WHEN n >= 45 THEN 'high' ELSE 'medium' END AS severity, src_ip, 40 AS score FROM scans
  UNION ALL SELECT c, 'brute_force', CASE WHEN n >= 32 THEN 'critical' ELSE 'high' END, src_ip, 50 FROM brute
  UNION ALL SELECT c, 'traffic_spike', 'medium', src_ip, n FROM spikes
  UNION ALL SELECT c, 'suspicious_ip', CASE WHEN score >= 80 THEN 'critical' ELSE 'high' END, src_ip, score FROM suspects)""",
    "'alert' AS part, ts, kind, severity, src_ip, score, NULL::BIGINT AS bytes, NULL::BIGINT AS sources") + """
UNION ALL SELECT 'window', CAST(g.c * 15 AS DOUBLE), NULL, NULL, NULL, count(src_ip), CAST(coalesce(sum(length), 0) AS BIGINT), count(DISTINCT src_ip)
FROM grid g LEFT JOIN pc ON pc.c = g.c GROUP BY g.c
UNION ALL SELECT 'reputation', CAST(max(c) * 15 AS DOUBLE), NULL, NULL, src_ip, CAST(max(score) AS BIGINT), NULL, NULL FROM scores GROUP BY src_ip""")
def mon_cycle(spark, sf_dir):
    """The whole monitor over a replay: alerts after suppression, traffic windows (empty ones, too) and the reputation."""
    logins = view(spark, sf_dir, "auth_events").select("ts", "src_ip", "username", "service", "port", "success")
    flows = monitor_packets(spark, sf_dir).select("ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length", "flags")
    blocklist = view(spark, sf_dir, "blocklist")
    root = replay(live.merged(flows, logins), lambda s: s.drop("event_time"), start=lambda out, root: out.writeStream.foreachBatch(
        live.cycle_sink(root, blocklist)))
    none = F.lit(None).cast("string")
    alerts = live.stored(spark, root, "alerts").select(
        F.lit("alert").alias("part"), "ts", "kind", "severity", "src_ip", F.col("score").cast("bigint").alias("score"), F.lit(None).cast("bigint").alias("bytes"), F.lit(None).cast("bigint").alias("sources"))
    totals = live.stored(spark, root, "traffic_windows").select(
        F.lit("window"), "window_end", none, none, none, "packet_count", "byte_count", "unique_sources")
    scores = live.reputation_before(spark, root, 1 << 62).select(
        F.lit("reputation"), "last_seen", none, none, "ip", F.col("score").cast("bigint"), F.lit(None).cast("bigint"), F.lit(None).cast("bigint"))
    return alerts.union(totals).union(scores)
