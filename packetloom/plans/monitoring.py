"""Queries over the monitor's tables: findings, reputation, blocklists, dashboards, log and feed parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import monitor_flag_text
from ..functions.text import iso_time
from ..operators import dashboard as board
from ..operators import monitor, reputation
from ..sources import authlog, feeds, tables
from .registry import greedy, query
from .traffic import FLAG_TEXT
from .views import view

SYN_TEXT = f"({FLAG_TEXT} LIKE '%SYN%' AND {FLAG_TEXT} NOT LIKE '%ACK%')"
LAST = "(SELECT max(ts) FROM packets)"


def packets(spark, sf_dir):
    return view(spark, sf_dir, "packets").withColumn("flags", monitor_flag_text(F.col("tcp_flags")))


def auth(spark, sf_dir):
    return view(spark, sf_dir, "auth_events")


def _end(df):
    """Time of the newest row, as the dashboards' ``as_of``."""
    return monitor.latest(df)


_SCAN_COLUMNS = """kind, severity, src_ip, ports, packets, syns, CAST(40 AS INT) AS score"""


@query("mon_port_scan", "packets", sql=f"""
SELECT ts, 'port_scan' AS kind, CASE WHEN ports >= 45 THEN 'high' ELSE 'medium' END AS severity, src_ip,
  ports, packets, syns, CAST(40 AS INT) AS score
FROM (SELECT {LAST} AS ts, src_ip, count(DISTINCT dst_port) AS ports, count(*) AS packets,
        count(*) FILTER ({SYN_TEXT}) AS syns
      FROM packets WHERE ts >= {LAST} - 60 AND dst_port IS NOT NULL GROUP BY src_ip)
WHERE ports >= 15 AND src_ip NOT IN ('127.0.0.1', '10.0.0.1')""")
def mon_port_scan(spark, sf_dir):
    return monitor.port_scans(packets(spark, sf_dir)).drop("title", "detail")


@query("mon_port_scan_cycles", "packets", sql=f""",
cycles AS (SELECT p.*, unnest(range(CAST(ceil(ts / 15) AS BIGINT), CAST(floor((ts + 60) / 15) AS BIGINT) + 1)) AS c FROM packets p)
SELECT ts, 'port_scan' AS kind, CASE WHEN ports >= 45 THEN 'high' ELSE 'medium' END AS severity, src_ip,
  ports, packets, syns, CAST(40 AS INT) AS score
FROM (SELECT CAST(c * 15 AS DOUBLE) AS ts, src_ip, count(DISTINCT dst_port) AS ports, count(*) AS packets,
        count(*) FILTER ({SYN_TEXT}) AS syns FROM cycles WHERE dst_port IS NOT NULL GROUP BY src_ip, c)
WHERE ports >= 15 AND src_ip NOT IN ('127.0.0.1', '10.0.0.1')""")
def mon_port_scan_cycles(spark, sf_dir):
    return monitor.port_scan_cycles(packets(spark, sf_dir)).drop("title", "detail")


@query("mon_brute_force", "auth_events", sql="""
, latest AS (SELECT max(ts) AS t FROM auth_events)
SELECT t AS ts, 'brute_force' AS kind, CASE WHEN failures >= 32 THEN 'critical' ELSE 'high' END AS severity, src_ip,
  failures, users, CAST(50 AS INT) AS score
FROM (SELECT t, src_ip, count(*) AS failures, count(DISTINCT username) AS users FROM auth_events, latest
      WHERE ts >= t - 900 AND NOT success GROUP BY t, src_ip) WHERE failures >= 8""")
def mon_brute_force(spark, sf_dir):
    return monitor.brute_force(auth(spark, sf_dir), window=900).drop("title", "detail")


@query("mon_brute_force_cycles", "auth_events", sql="""
, cycles AS (SELECT a.*, unnest(range(CAST(ceil(ts / 15) AS BIGINT), CAST(floor((ts + 300) / 15) AS BIGINT) + 1)) AS c
             FROM auth_events a WHERE NOT success)
SELECT ts, 'brute_force' AS kind, CASE WHEN failures >= 32 THEN 'critical' ELSE 'high' END AS severity, src_ip,
  failures, users, CAST(50 AS INT) AS score
FROM (SELECT CAST(c * 15 AS DOUBLE) AS ts, src_ip, count(*) AS failures, count(DISTINCT username) AS users
      FROM cycles GROUP BY src_ip, c) WHERE failures >= 8""")
def mon_brute_force_cycles(spark, sf_dir):
    return monitor.brute_force_cycles(auth(spark, sf_dir)).drop("title", "detail")


@query("mon_traffic_totals", "packets", sql=f"""
SELECT count(*) AS packets, CAST(coalesce(sum(length), 0) AS BIGINT) AS bytes, count(DISTINCT src_ip) AS sources
FROM packets WHERE ts >= {LAST} - 60""")
def mon_traffic_totals(spark, sf_dir):
    return monitor.traffic_totals(packets(spark, sf_dir))


@query("mon_top_talker", "packets", sql=f"""
SELECT src_ip, count(*) AS packets FROM packets WHERE ts >= {LAST} - 60 GROUP BY src_ip ORDER BY 2 DESC, 1 LIMIT 1""")
def mon_top_talker(spark, sf_dir):
    return monitor.top_talker(packets(spark, sf_dir))


@query("mon_spike", "packets", sql="""
, counts AS (SELECT CAST(floor(ts / 20) AS BIGINT) AS w, src_ip, count(*) AS n FROM packets GROUP BY 1, 2),
dense AS (SELECT unnest(range((SELECT min(w) FROM counts), (SELECT max(w) FROM counts) + 1)) AS w),
series AS (SELECT d.w, coalesce(sum(n), 0) AS packets, arg_max(src_ip, {'n': n, 's': src_ip}) AS top
           FROM dense d LEFT JOIN counts c ON c.w = d.w GROUP BY d.w),
base AS (SELECT *, avg(packets) OVER b AS mean, stddev_pop(packets) OVER b AS dev, count(*) OVER b AS k FROM series
         WINDOW b AS (ORDER BY w ROWS BETWEEN 11 PRECEDING AND 2 PRECEDING))
SELECT CAST((w + 1) * 20 AS DOUBLE) AS ts, 'traffic_spike' AS kind, 'medium' AS severity, top AS src_ip,
  CAST(packets AS INT) AS score, CAST(packets AS BIGINT) AS packets, round(mean, 4) AS mean,
  round(mean + 1.0 * CASE WHEN dev = 0 THEN 1.0 ELSE dev END, 4) AS threshold
FROM base WHERE k >= 3 AND packets >= 50 AND packets > mean + 1.0 * CASE WHEN dev = 0 THEN 1.0 ELSE dev END""")
def mon_spike(spark, sf_dir):
    spikes = monitor.traffic_spikes(packets(spark, sf_dir), window=20, multiplier=1.0)
    return spikes.drop("title", "detail").withColumn("mean", F.round("mean", 4)).withColumn(
        "threshold", F.round("threshold", 4))


@query("mon_spike_slide", "packets", sql="""
, cycles AS (SELECT p.src_ip, unnest(range(CAST(ceil(ts / 15) AS BIGINT), CAST(floor((ts + 60) / 15) AS BIGINT) + 1)) AS c FROM packets p),
counts AS (SELECT c, src_ip, count(*) AS n FROM cycles GROUP BY 1, 2),
dense AS (SELECT unnest(range((SELECT min(c) FROM counts), (SELECT max(c) FROM counts) + 1)) AS c),
series AS (SELECT d.c, coalesce(sum(n), 0) AS packets, arg_max(src_ip, {'n': n, 's': src_ip}) AS top FROM dense d LEFT JOIN counts k ON k.c = d.c GROUP BY d.c),
base AS (SELECT *, avg(packets) OVER b AS mean, stddev_pop(packets) OVER b AS dev, count(*) OVER b AS k FROM series
         WINDOW b AS (ORDER BY c ROWS BETWEEN 14 PRECEDING AND 5 PRECEDING))
SELECT CAST(c * 15 AS DOUBLE) AS ts, 'traffic_spike' AS kind, 'medium' AS severity, top AS src_ip, CAST(packets AS INT) AS score, CAST(packets AS BIGINT) AS packets,
  round(mean, 4) AS mean, round(mean + 1.0 * CASE WHEN dev = 0 THEN 1.0 ELSE dev END, 4) AS threshold
FROM base WHERE k >= 3 AND packets >= 50 AND packets > mean + 1.0 * CASE WHEN dev = 0 THEN 1.0 ELSE dev END""")
def mon_spike_slide(spark, sf_dir):
    """Every detection cycle, windows that overlap."""
    spikes = monitor.spike_cycles(packets(spark, sf_dir), multiplier=1.0)
    return spikes.drop("title", "detail").withColumn("mean", F.round("mean", 4)).withColumn("threshold", F.round("threshold", 4))


ACTIVE = """
, latest AS (SELECT greatest((SELECT max(ts) FROM packets), (SELECT max(ts) FROM auth_events)) AS t),
active AS (SELECT DISTINCT src_ip FROM (
  SELECT src_ip FROM packets, latest WHERE ts >= t - 20000 UNION ALL SELECT src_ip FROM auth_events, latest WHERE ts >= t - 20000))
"""


@query("active_sources", "packets", "auth_events", sql=ACTIVE + "SELECT src_ip FROM active")
def active_sources(spark, sf_dir):
    return monitor.active_sources(packets(spark, sf_dir), auth(spark, sf_dir), window=20000)


@query("blocklist_semi", "packets", "auth_events", "blocklist",
       sql=ACTIVE + "SELECT src_ip FROM active WHERE src_ip IN (SELECT ip FROM blocklist)")
def blocklist_semi(spark, sf_dir):
    active = monitor.active_sources(packets(spark, sf_dir), auth(spark, sf_dir), window=20000)
    return monitor.blocklisted(active, view(spark, sf_dir, "blocklist"))


@query("blocklist_networks", "packets", sql="""
SELECT src_ip, CASE WHEN src_ip LIKE '203.0.113.%' THEN '203.0.113.0/24' ELSE '10.0.0.4/31' END AS network,
  CASE WHEN src_ip LIKE '203.0.113.%' THEN 'feedA' ELSE 'feedB' END AS source
FROM (SELECT DISTINCT src_ip FROM packets) WHERE src_ip LIKE '203.0.113.%' OR src_ip IN ('10.0.0.4', '10.0.0.5')""")
def blocklist_networks(spark, sf_dir):
    networks = spark.sql("SELECT * FROM VALUES ('203.0.113.0/24', 'feedA'), ('10.0.0.4/31', 'feedB'), ('192.0.2.7', 'feedB') AS t(network, source)")
    sources = packets(spark, sf_dir).select("src_ip").distinct()
    return monitor.blocklisted_networks(sources, networks).select("src_ip", "network", "source")


@query("blocklist_upsert", "packets", "blocklist", sql="""
, fetched AS (SELECT src_ip AS ip, 'feedC' AS source, max(ts) AS fetched_at FROM packets WHERE tcp_flags = 41 GROUP BY src_ip)
SELECT coalesce(f.ip, b.ip) AS ip, coalesce(f.source, b.source) AS source, coalesce(f.fetched_at, 1.0) AS fetched_at
FROM blocklist b FULL JOIN fetched f ON f.ip = b.ip""")
def blocklist_upsert(spark, sf_dir):
    existing = view(spark, sf_dir, "blocklist").withColumn("fetched_at", F.lit(1.0))
    fetched = packets(spark, sf_dir).filter("tcp_flags = 41").groupBy(F.col("src_ip").alias("ip")).agg(
        F.max("ts").alias("fetched_at")).withColumn("source", F.lit("feedC"))
    return tables.upsert_blocklist(existing, fetched)


@query("blocklist_extract", sql=r"""
WITH lines AS (SELECT doc_id, trim(line, ' ' || chr(9)) AS line FROM (
  SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c]')) AS line FROM documents)),
kept AS (SELECT doc_id, line, split_part(regexp_split_to_array(line, '\s+')[1], ';', 1) AS token FROM lines
  WHERE line <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, ';') AND NOT starts_with(line, '//')),
ips AS (SELECT doc_id, CASE WHEN regexp_full_match(token, '(\d{1,3}\.){3}\d{1,3}(/\d{1,2})?') THEN split_part(token, '/', 1)
  ELSE regexp_extract(line, '\b(\d{1,3}\.){3}\d{1,3}\b') END AS ip FROM kept)
SELECT DISTINCT doc_id, ip FROM ips WHERE ip <> ''
  AND list_bool_and(list_transform(string_split(ip, '.'), lambda o: CAST(o AS INT) <= 255))""")
def blocklist_extract(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return feeds.parse_any(feeds.lines_of(documents, "text")).select("doc_id", "ip").distinct()


@query("feed_lines_strict", "packets", sql="""
SELECT src_ip AS ip, count(*) AS lines FROM packets WHERE tcp_flags = 41 OR tcp_flags = 17 GROUP BY 1""")
def feed_lines_strict(spark, sf_dir):
    """Feed text made from the packets: comments, networks, trailing remarks."""
    p = packets(spark, sf_dir)
    text = (
        F.when(F.col("tcp_flags") == 41, F.concat(F.lit("  "), F.col("src_ip"), F.lit("/24 ; seen scanning")))
        .when(F.col("tcp_flags") == 17, F.concat(F.col("src_ip"), F.lit(";closed")))
        .when(F.col("tcp_flags") == 24, F.concat(F.lit("# "), F.col("src_ip")))
        .otherwise(F.concat(F.lit("host "), F.col("src_ip")))
    )
    return feeds.parse_listed(p.select(text.alias("value"))).groupBy("ip").agg(F.count("*").alias("lines"))


@query("feed_pages", sql=r"""
SELECT unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)^.*?<body[^>]*>|</body\s*>.*$', ' ', 'g'),
  '(?s)<!--.*?-->|<[^>]*>', ' ', 'g'), '\b(?:\d{1,3}\.){3}\d{1,3}\b')) AS ip, url AS source FROM pages""")
def feed_pages(spark, sf_dir):
    return feeds.parse_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("auth_parse", "auth_lines", "auth_events", sql="""
SELECT l.event_id, l.ts, a.src_ip, a.username, 'sshd' AS service, CASE WHEN contains(line, ' port ') THEN TRY_CAST(regexp_extract(line, ' port ([0-9]+)', 1) AS BIGINT) ELSE 22 END AS port,
  a.success FROM auth_lines l JOIN auth_events a USING (event_id)""")
def auth_parse(spark, sf_dir):
    return authlog.parse_lines(view(spark, sf_dir, "auth_lines"))


# ---- reputation -------------------------------------------------------------------------

FOLDED = """
, ordered AS (SELECT ip, list({'ts': ts, 'points': points, 'score': 0::BIGINT} ORDER BY ts, seq) AS l,
    min(ts) AS first_seen, max(ts) AS last_seen FROM score_events GROUP BY ip),
latest AS (SELECT max(ts) + 100 AS t FROM score_events),
reduced AS (SELECT ip, first_seen, last_seen, list_reduce(list_prepend({'ts': l[1].ts, 'points': 0::INT, 'score': 0::BIGINT}, l),
  lambda a, x: {'ts': x.ts, 'points': x.points, 'score': least(100, x.points + greatest(0, a.score
     - 5 * greatest(0, CAST(ceil(x.ts / 15) AS BIGINT) - 1 - CAST(floor((a.ts + 180) / 15) AS BIGINT))))}).score AS s FROM ordered),
flags AS (SELECT ip, arg_max(blocklisted, ts * 4 + seq) FILTER (blocklisted IS NOT NULL) AS flag FROM score_events GROUP BY ip),
notes AS (SELECT ip, string_agg(note, '; ' ORDER BY ts, seq) AS notes FROM (
  SELECT ip, note, ts, seq FROM score_events QUALIFY row_number() OVER (PARTITION BY ip, note ORDER BY ts, seq) = 1) GROUP BY ip),
reputation AS (SELECT ip, CAST(greatest(0, s - 5 * greatest(0, CAST(floor(t / 15) AS BIGINT) - CAST(floor((last_seen + 180) / 15) AS BIGINT))) AS INT) AS score,
  first_seen, last_seen, coalesce(flag, false) AS blocklisted, notes FROM reduced JOIN notes USING (ip) JOIN flags USING (ip), latest)
"""


def reputation_table(spark, sf_dir):
    events = view(spark, sf_dir, "score_events")
    end = events.agg((F.max("ts") + 100).alias("t")).scalar()
    return reputation.fold(events, end, decay_hours=0.05)


@query("reputation_fold", "score_events", sql=FOLDED + "SELECT * FROM reputation")
def reputation_fold(spark, sf_dir):
    return reputation_table(spark, sf_dir)


@query("mon_suspicious_ip", "score_events", sql=FOLDED + """
SELECT t AS ts, 'suspicious_ip' AS kind, CASE WHEN score >= 80 THEN 'critical' ELSE 'high' END AS severity, ip AS src_ip,
  'Suspicious IP ' || ip || ' (score ' || score || ')' AS title, 'blocklisted=' || CASE WHEN blocklisted THEN 'True' ELSE 'False' END || ' reasons=' || notes AS detail, score
FROM reputation, latest WHERE score >= 50 AND last_seen >= t - 900""")
def mon_suspicious_ip(spark, sf_dir):
    end = view(spark, sf_dir, "score_events").agg((F.max("ts") + 100).alias("t")).scalar()
    return monitor.suspicious_ips(reputation_table(spark, sf_dir), end)


@query("top_suspects", "score_events", sql=FOLDED + "SELECT * FROM reputation ORDER BY score DESC, ip LIMIT 3")
def top_suspects(spark, sf_dir):
    return reputation.top_suspects(reputation_table(spark, sf_dir), 3)


@query("stat_reputation", "score_events", sql=FOLDED + """
SELECT count(*) FILTER (score >= 50) AS suspicious, count(*) FILTER (blocklisted) AS blocklisted FROM reputation""")
def stat_reputation(spark, sf_dir):
    return board.reputation_counts(reputation_table(spark, sf_dir))


# ---- alerts and dashboards --------------------------------------------------------------

@query("mon_suppress", "alerts", sql=greedy(300, """
SELECT kind || '/' || coalesce(src_ip, '-') AS k, ts, id AS pkt_id, id, kind, severity, src_ip, title, score FROM alerts
WHERE severity IN ('medium', 'high', 'critical')""", "id, ts, kind, severity, src_ip, title, score"))
def mon_suppress(spark, sf_dir):
    return monitor.suppress(view(spark, sf_dir, "alerts").drop("detail"))


@query("mon_not_in_cooldown", "alerts", sql="""
, latest AS (SELECT max(ts) AS t FROM alerts),
stored AS (SELECT kind, src_ip, max(ts) AS last_ts FROM alerts, latest WHERE ts < t - 250 GROUP BY kind, src_ip),
now AS (SELECT a.* FROM alerts a, latest WHERE ts >= t - 250)
SELECT n.id, n.ts, n.kind, n.src_ip FROM now n LEFT JOIN stored s ON s.kind = n.kind AND s.src_ip IS NOT DISTINCT FROM n.src_ip
WHERE n.ts - coalesce(s.last_ts, 0) >= 300""")
def mon_not_in_cooldown(spark, sf_dir):
    alerts = view(spark, sf_dir, "alerts").select("id", "ts", "kind", "src_ip")
    edge = _end(alerts) - 250
    return monitor.not_in_cooldown(alerts.filter(F.col("ts") >= edge), alerts.filter(F.col("ts") < edge))


@query("alerts_by_kind_severity", "alerts", sql="""
SELECT kind, severity, count(*) AS total FROM alerts WHERE ts >= (SELECT max(ts) FROM alerts) - 7200 GROUP BY 1, 2""")
def alerts_by_kind_severity(spark, sf_dir):
    alerts = view(spark, sf_dir, "alerts")
    return board.alerts_by_kind_severity(alerts, _end(alerts), hours=2)


@query("alerts_by_kind", "alerts", sql="SELECT kind, count(*) AS total FROM alerts GROUP BY kind")
def alerts_by_kind(spark, sf_dir):
    return board.alerts_by_kind(view(spark, sf_dir, "alerts"))


@query("alerts_5min", "alerts", sql="""
SELECT CAST(floor(ts / 300) AS BIGINT) * 300000 AS time, kind, count(*) AS total FROM alerts GROUP BY 1, 2""")
def alerts_5min(spark, sf_dir):
    return board.alerts_per_bucket(view(spark, sf_dir, "alerts"))


@query("stat_alerts", "alerts", sql="SELECT count(*) AS alerts FROM alerts WHERE ts >= (SELECT max(ts) FROM alerts) - 3600")
def stat_alerts(spark, sf_dir):
    alerts = view(spark, sf_dir, "alerts")
    return board.alert_count(alerts, _end(alerts), hours=1)


@query("stat_failed_logins", "auth_events", sql="""
SELECT count(*) AS failures FROM auth_events WHERE NOT success AND ts >= (SELECT max(ts) FROM auth_events) - 3600""")
def stat_failed_logins(spark, sf_dir):
    events = auth(spark, sf_dir)
    return board.failed_logins(events, _end(events))


@query("stat_blocklist", "packets", "blocklist", sql="""
SELECT count(*) AS entries FROM (SELECT ip FROM blocklist UNION SELECT src_ip FROM packets WHERE tcp_flags = 41)""")
def stat_blocklist(spark, sf_dir):
    return board.blocklist_size(blocklist_upsert(spark, sf_dir))


@query("series_volume", "packets", sql="""
SELECT CAST(floor(ts / 60) AS BIGINT) * 60000 AS time, count(*) AS packets, count(DISTINCT src_ip) AS sources FROM packets GROUP BY 1""")
def series_volume(spark, sf_dir):
    return board.volume_series(monitor.traffic_windows(packets(spark, sf_dir)))


@query("recent_alerts", "alerts", sql="""
SELECT strftime(make_timestamp(CAST(ts * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS time, severity, kind, src_ip, title, detail
FROM alerts ORDER BY ts DESC, id DESC LIMIT 50""")
def recent_alerts(spark, sf_dir):
    return board.recent_alerts(view(spark, sf_dir, "alerts"))


@query("alert_lines", "alerts", sql="""
SELECT id, strftime(make_timestamp(CAST(ts * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS timestamp, upper(severity) AS severity FROM alerts""")
def alert_lines(spark, sf_dir):
    return view(spark, sf_dir, "alerts").select("id", iso_time(F.col("ts")).alias("timestamp"), F.upper("severity").alias("severity"))


@query("purge", "packets", sql=f"""
SELECT pkt_id, ts, src_ip FROM packets WHERE ts >= {LAST} - 0.001 * 86400""")
def purge(spark, sf_dir):
    rows = packets(spark, sf_dir)
    return tables.retained(rows, _end(rows), days=0.001).select("pkt_id", "ts", "src_ip")
