"""Network-shaped views over the given tables.

Each text runs unchanged in Spark SQL and in the comparison engine, so a query and its
comparison SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "packets": ("lineitem", """
SELECT ((l_orderkey*8 + l_linenumber)*32768 + l_partkey)*1024 + l_suppkey AS pkt_id,
  CAST(1700000000 AS DOUBLE) + CAST(l_orderkey AS DOUBLE)/32 + CAST(l_linenumber AS DOUBLE)/1024
    + CAST(l_partkey AS DOUBLE)/1048576 AS ts,
  CASE WHEN l_suppkey%8=1 THEN concat('203.0.113.', CAST(l_suppkey%4+1 AS STRING))
       ELSE concat('10.0.0.', CAST(l_suppkey%8+1 AS STRING)) END AS src_ip,
  CASE WHEN l_suppkey%8 IN (3,6,7) THEN '192.168.1.10'
       WHEN l_suppkey%8=5 THEN concat('192.168.1.', CAST(l_partkey%40+1 AS STRING))
       WHEN l_suppkey%8=2 THEN '198.51.100.77'
       ELSE concat('192.168.1.', CAST(l_partkey%4+1 AS STRING)) END AS dst_ip,
  CAST(30000 + l_partkey%20000 AS INT) AS src_port,
  CAST(CASE WHEN l_suppkey%8=3 THEN l_partkey%1000+1 WHEN l_suppkey%8 IN (5,6,7) THEN 80
       WHEN l_suppkey%8=4 THEN 53 WHEN l_suppkey%8=2 THEN 4444 ELSE 443 END AS INT) AS dst_port,
  CASE WHEN l_suppkey%8=4 THEN 'UDP' ELSE 'TCP' END AS protocol,
  CAST(floor(l_quantity*28) AS INT) AS length,
  CAST(CASE WHEN l_suppkey%8=4 THEN NULL
       WHEN l_suppkey%8 IN (3,5,6,7) THEN CASE WHEN l_partkey%97=0 THEN 41 ELSE 2 END
       WHEN l_returnflag='R' THEN 17 ELSE 24 END AS INT) AS tcp_flags,
  CASE WHEN l_suppkey%8=4 THEN concat(md5(CAST(l_orderkey*8+l_linenumber AS STRING)),
       substr(md5(CAST(l_partkey AS STRING)),1,20), '.t', CAST(l_suppkey%3 AS STRING), '.example') END AS qname,
  CAST(CASE WHEN l_suppkey%8=4 THEN CASE WHEN l_partkey%10=0 THEN 16 ELSE 1 END END AS INT) AS qtype
FROM lineitem"""),
    "auth_events": ("events", """
SELECT event_id, CAST(1700000000 AS DOUBLE) + event_id*2 AS ts,
  concat('198.51.100.', CAST(user_id%4+1 AS STRING)) AS src_ip,
  concat('u', CAST(user_id AS STRING)) AS username, 'sshd' AS service,
  CAST(22 AS INT) AS port, event_type <> 'error' AS success FROM events"""),
    "auth_lines": ("auth_events", """
SELECT event_id, ts, CASE WHEN success THEN concat('Accepted password for ', username, ' from ', src_ip, ' port ',
    CASE event_id%50 WHEN 1 THEN '99999999999' WHEN 2 THEN repeat('9', 40) ELSE '50022' END, ' ssh2')
  WHEN event_id%3=0 THEN concat('Invalid user ', username, ' from ', src_ip)
  WHEN event_id%3=1 THEN concat('Failed password for invalid user ', username, ' from ', src_ip, ' port 50022 ssh2')
  ELSE concat('authentication failure; uid=0 rhost=', src_ip, ' user=', username) END AS line FROM auth_events"""),
    "services": ("part", """
SELECT p_partkey AS service_id, concat('192.168.', CAST(p_partkey%8 AS STRING), '.', CAST(p_partkey%50+1 AS STRING)) AS host,
  CAST(CASE p_partkey%12 WHEN 0 THEN 22 WHEN 1 THEN 21 WHEN 2 THEN 80 WHEN 3 THEN 8080 WHEN 4 THEN 25 WHEN 5 THEN 445
       WHEN 6 THEN 6379 WHEN 7 THEN 21 WHEN 8 THEN 80 WHEN 9 THEN 110 WHEN 10 THEN 3389 ELSE 64999 END AS INT) AS port,
  CASE p_partkey%12 WHEN 0 THEN CASE p_size%3 WHEN 0 THEN 'SSH-2.0-OpenSSH_7.2p2 Ubuntu' WHEN 1 THEN 'SSH-2.0-OpenSSH_8.9p1' ELSE 'SSH-2.0-OpenSSH_9.8p1' END
       WHEN 1 THEN '220 (vsFTPd 2.3.4)' WHEN 2 THEN concat('Server: Apache/2.4.', CAST(p_size AS STRING), ' (Unix)')
       WHEN 3 THEN 'Server: nginx/1.4.0' WHEN 4 THEN '220 mail ESMTP Exim 4.89' WHEN 5 THEN 'Samba 4.6.3'
       WHEN 6 THEN 'redis_version:6.2.6' WHEN 7 THEN '220 ProFTPD 1.3.5 Server' WHEN 8 THEN 'Server: Microsoft-IIS/6.0'
       WHEN 9 THEN '+OK Dovecot ready' WHEN 10 THEN NULL
       ELSE CASE WHEN p_size%5=0 THEN concat('SSH-2.0-OpenSSH_', repeat('9', 45), '.', CAST(p_size AS STRING)) ELSE 'gibberish' END END AS banner FROM part"""),
    "blocklist": ("", """
SELECT * FROM (VALUES ('203.0.113.2','feedA'),('198.51.100.3','feedA'),('10.0.0.4','feedB')) AS t(ip, source)"""),
    # Sample vulnerability records.
    "cves": ("", """
SELECT * FROM (VALUES
  ('openssh', 0, 'CVE-2018-15473', 5.3, '<7.7', '7.7'),
  ('openssh', 1, 'CVE-2016-6210', 5.9, '<7.3', '7.3'),
  ('openssh', 2, 'CVE-2020-14145', 5.9, '>=5.7 <8.4', '8.4'),
  ('apache httpd', 0, 'CVE-2021-41773', 7.5, '==2.4.49', '2.4.50'),
  ('apache httpd', 1, 'CVE-2021-42013', 9.8, '>=2.4.49 <=2.4.50', '2.4.51'),
  ('apache httpd', 2, 'CVE-2019-0211', 7.8, '>=2.4.17 <2.4.39', '2.4.39'),
  ('nginx', 0, 'CVE-2013-2028', 7.5, '>=1.3.9 <=1.4.0', '1.4.1'),
  ('nginx', 1, 'CVE-2019-20372', 5.3, '<1.17.7', '1.17.7'),
  ('vsftpd', 0, 'CVE-2011-2523', 9.8, '==2.3.4', '2.3.5'),
  ('proftpd', 0, 'CVE-2015-3306', 10.0, '>=1.3.5 <1.3.5a', '1.3.5a'),
  ('exim', 0, 'CVE-2019-15846', 9.8, '<4.92.2', '4.92.2'),
  ('exim', 1, 'CVE-2019-10149', 9.8, '>=4.87 <=4.91', '4.92'),
  ('samba', 0, 'CVE-2017-7494', 9.8, '>=3.5.0 <4.6.4', '4.6.4'),
  ('openssl', 0, 'CVE-2014-0160', 7.5, '>=1.0.1 <1.0.1g', '1.0.1g'),
  ('microsoft-iis', 0, 'CVE-2017-7269', 9.8, '==6.0', '7.0'),
  ('redis', 0, 'CVE-2022-0543', 10.0, '<7.0.0', '7.0.0'),
  ('memcached', 0, 'CVE-2018-1000115', 7.5, '<1.5.6', '1.5.6')
) AS t(product, position, cve_id, cvss, affected, fixed_version)"""),
    "score_events": ("auth_events", """
SELECT concat('198.51.100.', CAST(CAST(substr(username, 2) AS INT)%20+1 AS STRING)) AS ip, ts*1 AS ts, CAST(event_id%4 AS INT) AS seq,
  CAST(CASE event_id%4 WHEN 0 THEN 14 WHEN 1 THEN 17 WHEN 2 THEN 9 ELSE 21 END AS INT) AS points,
  CASE event_id%4 WHEN 0 THEN 'port_scan' WHEN 1 THEN 'brute_force' WHEN 2 THEN 'traffic_spike' ELSE 'threat_feed' END AS note,
  CASE WHEN CAST(substr(username, 2) AS INT)%20 IN (3, 7) AND event_id%4=3 THEN true
       WHEN CAST(substr(username, 2) AS INT)%20 = 7 AND event_id%4=0 THEN false END AS blocklisted
  FROM auth_events WHERE NOT success"""),
    "icmp_packets": ("events", """
SELECT event_id AS pkt_id, CAST(1700000000 AS DOUBLE) + CAST(event_id AS DOUBLE)/4 AS ts,
  concat('10.0.1.', CAST(user_id%3+1 AS STRING)) AS src_ip, concat('192.168.1.', CAST(event_id%30+1 AS STRING)) AS dst_ip,
  CAST(CASE WHEN event_id%5=0 THEN 0 ELSE 8 END AS INT) AS icmp_type,
  CASE WHEN event_id%7=0 THEN concat(md5(CAST(event_id AS STRING)), md5(CAST(event_id+1 AS STRING)), md5(CAST(event_id+2 AS STRING)),
       md5(CAST(event_id+3 AS STRING)), md5(CAST(event_id+4 AS STRING)), md5(CAST(event_id+5 AS STRING)), md5(CAST(event_id+6 AS STRING)),
       md5(CAST(event_id+7 AS STRING)), md5(CAST(event_id+8 AS STRING)), md5(CAST(event_id+9 AS STRING))) ELSE '70696e67' END AS payload_hex FROM events"""),
    "http_messages": ("events", """
SELECT event_id AS pkt_id, CAST(1700000000 AS DOUBLE) + event_id AS ts, concat('10.0.2.', CAST(user_id%5+1 AS STRING)) AS src_ip,
  '192.168.1.10' AS dst_ip, CAST(80 AS INT) AS dst_port, 'request' AS kind,
  CASE WHEN event_type='signup' THEN 'POST' ELSE 'GET' END AS method, concat('/', event_type) AS path, 'intranet.local' AS http_host,
  CASE WHEN event_type='error' THEN 'Basic eDp5' END AS authorization,
  CASE WHEN event_type='signup' THEN concat('user=u', CAST(user_id AS STRING), '&password=x', CAST(event_id AS STRING)) ELSE '' END AS body FROM events"""),
    "alerts": ("auth_events", """
SELECT event_id AS id, ts, CASE event_id%4 WHEN 0 THEN 'port_scan' WHEN 1 THEN 'brute_force' WHEN 2 THEN 'traffic_spike' ELSE 'suspicious_ip' END AS kind,
  CASE event_id%5 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'high' END AS severity,
  CASE WHEN event_id%4 = 2 THEN NULL ELSE src_ip END AS src_ip, concat('finding ', CAST(event_id AS STRING)) AS title,
  username AS detail, CAST(event_id%100 AS INT) AS score FROM auth_events WHERE NOT success"""),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; sources it needs are read from ``sf_dir``."""
    source, text = VIEWS[name]
    if not source:
        return spark.sql(text)
    base = view(spark, sf_dir, source) if source in VIEWS else spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return spark.sql(text.replace(f"FROM {source}", "FROM {base}"), base=base)


def with_views(sql: str, *names: str) -> str:
    """Prefix comparison SQL with the views it uses; ``sql`` may begin with ``,`` and more CTEs."""
    needed: list[str] = []

    def add(name: str) -> None:
        if VIEWS[name][0] in VIEWS:
            add(VIEWS[name][0])
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    views = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in needed)
    return f"WITH RECURSIVE {views}\n{sql.strip()}"
