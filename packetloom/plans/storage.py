"""Queries that write tables, documents and captures to the work folder and read them back, and column helpers over whole tables."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import labels, net, text
from ..operators import monitor, targets
from ..session import new_folder
from ..sources import capture, tables
from .ingest import packet_frames
from .monitoring import packets
from .registry import query
from .traffic import http
from .views import view


# ---- stored tables ---------------------------------------------------------------------------------

def halves(df, table):
    """Two halves of the rows, told apart by the table's numbers alone: texts in the test would be made once more for it, beside their column."""
    columns = [c.split() for c in tables.SCHEMAS[table].split(", ")]
    rows, first = df.select(*[name for name, _ in columns]), F.xxhash64(*[name for name, kind in columns if kind != "string"]) % 2 == 0
    return rows.filter(first), rows.filter(~first)


def _stored(df, table):
    """Append the rows in two halves and read the table."""
    root = new_folder(df.sparkSession)
    for part in halves(df, table):
        tables.append(part, root, table)
    return tables.read(df.sparkSession, root, table)


DAY = "CAST(make_timestamp(CAST(floor(ts) AS BIGINT) * 1000000) AS DATE) AS day"


@query("sink_packets", "packets", sql=f"""
SELECT ts, src_ip, dst_ip, src_port, dst_port, protocol, length, {DAY}, '4:' || printf('%02x%02x%02x%02x',
  split_part(src_ip, '.', 1)::INT, split_part(src_ip, '.', 2)::INT, split_part(src_ip, '.', 3)::INT, split_part(src_ip, '.', 4)::INT) AS src_key FROM packets""")
def sink_packets(spark, sf_dir):
    return _stored(packets(spark, sf_dir), "packets").select(
        "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length", "day", "src_key")


@query("stored_net", "packets", sql="""
SELECT ts, src_ip, dst_ip, length FROM packets WHERE src_ip IN ('10.0.0.4', '10.0.0.5', '10.0.0.6', '10.0.0.7') AND dst_ip LIKE '192.168.%'""")
def stored_net(spark, sf_dir):
    """Networks as ranges of stored keys, which the scan prunes."""
    rows = _stored(packets(spark, sf_dir), "packets")
    return rows.filter(net.key_in_net(F.col("src_key"), "10.0.0.4/30") & net.key_in_net(F.col("dst_key"), "192.168.0.0/16")).select("ts", "src_ip", "dst_ip", "length")


@query("sink_auth", "auth_events", sql=f"SELECT ts, src_ip, username, service, port, success, {DAY} FROM auth_events")
def sink_auth(spark, sf_dir):
    return _stored(view(spark, sf_dir, "auth_events"), "auth_events").drop("src_key")


@query("sink_alerts", "alerts", sql="SELECT ts, kind, severity, src_ip, title, detail, score, false AS notified FROM alerts")
def sink_alerts(spark, sf_dir):
    return _stored(view(spark, sf_dir, "alerts").withColumn("notified", F.lit(False)), "alerts")


@query("sink_windows", "packets", sql="""
SELECT floor(ts / 60) * 60 AS window_start, (floor(ts / 60) + 1) * 60 AS window_end, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS byte_count,
  count(DISTINCT src_ip) AS unique_sources FROM packets GROUP BY 1, 2""")
def sink_windows(spark, sf_dir):
    return _stored(monitor.traffic_windows(packets(spark, sf_dir)), "traffic_windows").drop("day")


@query("purge_stored", "packets", sql="""
, both_days AS (SELECT * FROM packets UNION ALL SELECT * REPLACE (ts - 172740 AS ts) FROM packets UNION ALL SELECT * REPLACE (ts - 400000 AS ts) FROM packets)
SELECT ts, src_ip, length FROM both_days WHERE ts >= (SELECT max(ts) FROM packets) - 172800""")
def purge_stored(spark, sf_dir):
    """Expired days are deleted, the day of the cutoff is filtered, later days stay as they are."""
    rows = packets(spark, sf_dir)
    old = rows.withColumn("ts", F.col("ts") - 172740.0).unionByName(rows.withColumn("ts", F.col("ts") - 400000.0))
    root = new_folder(spark)
    names = [c.split()[0] for c in tables.SCHEMAS["packets"].split(", ")]
    tables.append(rows.unionByName(old).select(*names), root, "packets")
    for table in ("auth_events", "traffic_windows"):
        tables.append(spark.createDataFrame([], tables.SCHEMAS[table]), root, table)
    tables.purge(spark, root, rows.agg(F.max("ts")).first()[0], days=2)
    return tables.read(spark, root, "packets").select("ts", "src_ip", "length")


# ---- documents -------------------------------------------------------------------------------------

@query("sink_alert_lines", "alerts", sql="""
SELECT id, kind, src_ip, strftime(make_timestamp(CAST(ts * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS timestamp FROM alerts""")
def sink_alert_lines(spark, sf_dir):
    path = new_folder(spark)
    tables.write_alert_lines(view(spark, sf_dir, "alerts"), path)
    return spark.read.schema("id bigint, kind string, src_ip string, timestamp string").json(path)


@query("sink_alert_document", "alerts", sql="""
SELECT 0 AS part, NULL AS ts, 'replay' AS source, NULL AS rule, NULL AS hosts, count(*) AS packets FROM alerts
UNION ALL SELECT 1, ts, NULL, kind, CAST(score AS VARCHAR), NULL FROM alerts""")
def sink_alert_document(spark, sf_dir):
    alerts = view(spark, sf_dir, "alerts").select("ts", "severity", F.col("kind").alias("rule"), F.col("title").alias("message"), F.col("src_ip").alias("src"),
                                                  F.lit(None).cast("string").alias("dst"), F.create_map(F.lit("hosts"), F.col("score").cast("string")).alias("evidence"))
    totals = alerts.agg(F.count("*").alias("packets"), F.lit(0).cast("bigint").alias("bytes"))
    path = new_folder(spark)
    tables.alert_document(totals, alerts, "replay", None, 0.0).write.json(path)
    read = spark.read.schema("part int, ts double, json string").json(path)
    field = lambda name: F.get_json_object("json", f"$.{name}")
    return read.select("part", "ts", field("source").alias("source"), field("rule").alias("rule"), field("evidence.hosts").alias("hosts"), field("packets").cast("bigint").alias("packets"))


# ---- captures --------------------------------------------------------------------------------------

def write_captures(frames, files: int = 3):
    """Frames as classic capture files, one a task, named so that a repeated task writes the same file."""
    spark = frames.sparkSession
    root = new_folder(spark)
    spark.range(1).write.parquet(f"{root}/made")  # makes the folder where Spark can reach it
    folder = root.removeprefix("file://")

    def write(batches):
        from pyarrow import fs
        handles = {}
        for batch in batches:
            for name, ts, raw, wire in zip(*(batch.column(c).to_pylist() for c in ("name", "ts", "raw", "wire_length"))):
                if name not in handles:
                    handles[name] = fs.LocalFileSystem().open_output_stream(f"{folder}/{name}.pcap")
                    handles[name].write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1 if name.startswith("ether") else 101))
                handles[name].write(struct.pack("<IIII", int(ts), int((ts - int(ts)) * 1e6), len(raw), wire) + raw)
        for handle in handles.values():
            handle.close()
        yield pa.RecordBatch.from_arrays([pa.array(list(handles), pa.string())], ["name"])

    kind = F.when(F.col("linktype") == 1, "ether").otherwise("raw")
    named = frames.withColumn("name", F.concat(kind, (F.col("pkt_id") % files).cast("string"))).select("name", "ts", "raw", "wire_length", "pkt_id")
    named.repartition(2 * files, "name").sortWithinPartitions("name", "ts", "pkt_id").mapInArrow(write, "name string").collect()
    return f"{root}/*.pcap"


@query("capture_frames", "packets", sql="""
SELECT CASE protocol WHEN 'TCP' THEN 'ether' ELSE 'raw' END || pkt_id % 3 AS name,
  row_number() OVER (PARTITION BY protocol, pkt_id % 3 ORDER BY ts, pkt_id) - 1 AS frame_no, CAST(floor(ts) * 1000000 + floor((ts - floor(ts)) * 1000000) AS BIGINT) AS micros,
  CASE protocol WHEN 'TCP' THEN 1 ELSE 101 END AS linktype, CAST(length AS BIGINT) AS wire_length FROM packets""")
def capture_frames(spark, sf_dir):
    """Capture files cut into ranges of 64 KB, read in parallel and numbered as they stand in their file."""
    path = write_captures(packet_frames(spark, sf_dir))
    read = capture.read_frames(spark, path, split_bytes=1 << 16)
    return read.select(F.regexp_extract("file", r"(\w+)\.pcap$", 1).alias("name"), "frame_no", F.round(F.col("ts") * 1000000).cast("bigint").alias("micros"), "linktype", "wire_length")


# ---- ranges of addresses -----------------------------------------------------------------------------

@query("targets_join", "services", sql="""
, specs AS (SELECT service_id, service_id % 6 AS k, (service_id // 6 % 200)::BIGINT AS c FROM services),
ranges AS (
  SELECT service_id, 3232235520 + c * 256 + 16 AS low, 3232235520 + c * 256 + 31 AS high FROM specs WHERE k = 0
  UNION ALL SELECT service_id, 3232235520 + c * 256 + 3, 3232235520 + c * 256 + 9 FROM specs WHERE k = 1
  UNION ALL SELECT service_id, 3232235520 + c // 4 * 4 * 256, 3232235520 + c // 4 * 4 * 256 + 1023 FROM specs WHERE k = 2),
six AS (SELECT service_id, c FROM specs WHERE k = 3),
hosts AS (SELECT DISTINCT host, 3232235520 + split_part(host, '.', 3)::BIGINT * 256 + split_part(host, '.', 4)::BIGINT AS number FROM services)
SELECT host, service_id AS seq FROM hosts JOIN ranges ON number BETWEEN low AND high
UNION ALL SELECT 'fd00:' || printf('%x', h.n) || '::' || printf('%x', h.n + 1), service_id FROM (SELECT DISTINCT service_id % 50 AS n FROM services) h JOIN six ON h.n // 16 = c // 16""")
def targets_join(spark, sf_dir):
    """Which specified ranges an address lies in: networks, ranges and IPv6 networks that end inside a digit group."""
    services = view(spark, sf_dir, "services")
    k, c = F.col("service_id") % 6, F.floor(F.col("service_id") / 6) % 200
    spec = (F.when(k == 0, F.format_string("192.168.%d.16/28", c)).when(k == 1, F.format_string("192.168.%d.3-9", c))
            .when(k == 2, F.format_string("192.168.%d.0/22", c)).when(k == 3, F.format_string("fd00:%x::/28", c)))
    specs = services.select(F.col("service_id").alias("spec_id"), spec.alias("spec")).filter("spec IS NOT NULL")
    n = F.col("service_id") % 50
    six = services.select(F.format_string("fd00:%x::%x", n, n + 1).alias("host"))
    hosts = services.select("host").union(six).distinct().withColumn("key", net.ip_key(F.col("host")))
    return targets.inside(hosts, targets.ranges(specs)).select("host", "seq")


# ---- column helpers ------------------------------------------------------------------------------------

@query("size_texts", sql="""
, sized AS (SELECT l_orderkey, l_linenumber, (l_partkey::BIGINT * l_partkey * (l_linenumber * l_linenumber * 37 + 1) * 2 + 1) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, n, CASE WHEN n < 1024 THEN n || 'B' WHEN n < 1048576 THEN printf('%.1fKB', n / 1024) WHEN n < 1073741824 THEN printf('%.1fMB', n / 1048576)
  ELSE printf('%.1fGB', n / 1073741824) END AS size FROM sized""".replace(", sized", "WITH sized", 1))
def size_texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = F.col("l_partkey").cast("bigint") * F.col("l_partkey") * (F.col("l_linenumber") * F.col("l_linenumber") * 37 + 1) * 2 + 1
    return rows.select("l_orderkey", "l_linenumber", n.alias("n")).withColumn("size", text.human_bytes(F.col("n")))


@query("first_lines", sql=r"SELECT doc_id, substr(regexp_extract(text, '^[^\r\n]*'), 1, 70) AS line FROM documents")
def first_lines(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.first_line(F.col("text")).alias("line"))


@query("payload_previews", "http_messages", sql="""
SELECT pkt_id, substr(replace(replace(method || ' ' || path || ' HTTP/1.1' || chr(13) || chr(10) || 'Host: ' || http_host || coalesce(chr(13) || chr(10) || 'Authorization: ' || "authorization", '')
  || chr(13) || chr(10) || chr(13) || chr(10) || body, chr(13), '.'), chr(10), '.'), 1, 40) AS preview FROM http_messages""")
def payload_previews(spark, sf_dir):
    return http(spark, sf_dir).select("pkt_id", text.payload_preview(F.col("payload"), 40).alias("preview"))


@query("fragment_bits", sql="""
SELECT l_orderkey, l_linenumber, (l_linenumber & 2) <> 0 AS dont_fragment, (l_linenumber & 1) <> 0 AS more_fragments FROM lineitem""")
def fragment_bits(spark, sf_dir):
    flags = F.col("l_linenumber")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", labels.dont_fragment(flags).alias("dont_fragment"), labels.more_fragments(flags).alias("more_fragments"))
