import json

from pyspark.sql import functions as F

from packetloom.operators import monitor, reputation, targets, vulnerability
from packetloom.sources import authlog, cves, feeds, tables
from packetloom.streaming import monitor as live
from packetloom.streaming import rules as stream_rules
from packetloom.streaming import windows

NOW = 1700000400.0


def demo(spark):
    """Normal traffic, an 80-port scan, 40 failed logins, a burst after quiet minutes, listed sources."""
    packets = [(NOW - 55 + i * 0.1, "45.0.0.9", "10.0.0.5", 40000, i + 1, "TCP", 60, "SYN") for i in range(80)]
    packets += [(NOW - 700 + 60 * m + i, "10.0.0.22", "10.0.0.5", 50000, 443, "TCP", 500, "ACK") for m in range(10) for i in range(5)]
    packets += [(NOW - 20 + i * 0.001, "10.0.0.15", "10.0.0.5", 50000, 443, "TCP", 900, "ACK") for i in range(4000)]
    packets += [(NOW - 300, "185.0.0.7", "10.0.0.5", 1, 443, "TCP", 60, "ACK"), (NOW - 5, "127.0.0.1", "10.0.0.5", 1, 443, "TCP", 60, "ACK")]
    logins = [(NOW - 200 + i, "91.0.0.3", f"u{i % 5}", "sshd", 22, False) for i in range(40)]
    logins += [(NOW - 100, "10.0.0.22", "ann", "sshd", 22, True)]
    return (spark.createDataFrame(packets, tables.SCHEMAS["packets"]), spark.createDataFrame(logins, tables.SCHEMAS["auth_events"]),
            spark.createDataFrame([("185.0.0.7", "feed"), ("127.0.0.1", "feed")], "ip string, source string"))


def test_one_cycle(spark):
    packets, logins, blocklist = demo(spark)
    none = spark.createDataFrame([], "ip string, ts double, seq int, points int, note string, blocklisted boolean")
    alerts = {(r.kind, r.src_ip): r for r in monitor.detection_cycle(packets, logins, blocklist, none, NOW)[0].collect()}
    assert alerts[("port_scan", "45.0.0.9")].severity == "high"
    assert alerts[("port_scan", "45.0.0.9")].detail == "80 distinct ports, 80 packets, 80 SYN-only in 60s"
    assert alerts[("brute_force", "91.0.0.3")].severity == "critical"
    assert alerts[("traffic_spike", "10.0.0.15")].score == 4081
    assert alerts[("suspicious_ip", "185.0.0.7")].detail == "blocklisted=True reasons=threat_feed"
    assert alerts[("suspicious_ip", "91.0.0.3")].score == 50 and ("suspicious_ip", "127.0.0.1") not in alerts


def test_newest_instant_belongs_to_the_closing_window(spark):
    rows = [(NOW - 600 + 10 * i, "a", 1) for i in range(61)] + [(NOW, "b", 1)] * 400
    packets = spark.createDataFrame(rows, "ts double, src_ip string, length int")
    assert [r.ts for r in monitor.traffic_spikes(packets, origin=NOW).collect()] == [NOW]


def test_purge(spark, tmp_path):
    packets, _, _ = demo(spark)
    root = str(tmp_path / "store")
    tables.append(packets, root, "packets")
    tables.append(spark.createDataFrame([(NOW, "a", "u", "sshd", 22, True)], tables.SCHEMAS["auth_events"]), root, "auth_events")
    tables.append(packets.limit(10).withColumn("ts", F.lit(NOW - 8 * 86400)), root, "packets")
    tables.append(monitor.traffic_windows(packets), root, "traffic_windows")
    before = tables.read(spark, root, "packets").count()
    tables.purge(spark, root, NOW, days=7)
    assert tables.read(spark, root, "packets").count() == before - 10


def test_sink_does_not_depend_on_batches(spark, tmp_path):
    """One large batch, many small ones and repeated ones give the same alerts; empty cycles count."""
    packets, logins, blocklist = demo(spark)
    later = [(NOW + 60.0 * i, "10.0.0.22", "10.0.0.5", 1, 443, "TCP", 60, "ACK") for i in range(1, 8)]
    later += [(NOW + 200 + i * 0.05, "45.0.0.9", "10.0.0.5", 1, i + 1, "TCP", 60, "SYN") for i in range(40)]
    rows = live.merged(packets.unionByName(spark.createDataFrame(later, packets.schema)), logins).orderBy("ts").collect()
    schema = live.merged(packets, logins).schema

    def run(name, cuts, repeat=False):
        root = str(tmp_path / name)
        sink = live.cycle_sink(root, blocklist)
        for number, (low, high) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
            part = spark.createDataFrame(rows[low:high], schema).coalesce(1)
            sink(part, number)
            if repeat:
                sink(part, number)
        show = lambda table, *columns: sorted((tuple(r) for r in live.stored(spark, root, table).select(*columns).collect()), key=repr)
        return (show("alerts", "ts", "kind", "severity", "src_ip", "detail", "score"), show("traffic_windows", "window_end", "packet_count"),
                {r.ip: r.score for r in live.reputation_before(spark, root, 99).collect()}, live.stored(spark, root, "packets").count())

    whole = run("one", [])
    kinds = {(a[1], a[3]) for a in whole[0]}
    assert {("port_scan", "45.0.0.9"), ("brute_force", "91.0.0.3"), ("traffic_spike", "10.0.0.15"), ("suspicious_ip", "185.0.0.7"), ("suspicious_ip", "91.0.0.3")} <= kinds
    assert ("suspicious_ip", "127.0.0.1") not in kinds
    times = [a[0] for a in whole[0] if a[1] == "suspicious_ip" and a[3] == "185.0.0.7"]
    assert len(times) > 1 and all(b - a >= 300 for a, b in zip(times, times[1:]))
    ends = [w[0] for w in whole[1]]
    assert ends == [min(ends) + 15 * i for i in range(len(ends))] and any(n == 0 for _, n in whole[1])
    assert run("many", [40, 300, 2500, len(rows) - 30]) == whole
    assert run("twice", [1000], repeat=True) == whole


def test_reputation_day_borders(spark):
    """Folding per day gives what folding event by event gives."""
    events = [("x", 1000.0 + 9000.0 * i, i % 3, [40, 50, 20, 60][i % 4], ["a", "ab", "b", ""][i % 4]) for i in range(60)]
    events += [("y", 1000.0, 0, 250, "only")]
    df = spark.createDataFrame(events, "ip string, ts double, seq int, points int, note string")

    def ticks(last, until, inclusive):
        n, t = 0, (int((last + 3600) // 600) + 1) * 600
        while t < until or (inclusive and t == until):
            n, t = n + 1, t + 600
        return n

    end = 1000.0 + 9000.0 * 60
    want = {}
    for ip, ts, seq, points, _ in sorted(events, key=lambda e: (e[1], e[2])):
        score, last = want.get(ip, (0, ts))
        want[ip] = (min(100, max(0, score - 5 * ticks(last, ts, False)) + points), ts)
    want = {ip: max(0, s - 5 * ticks(last, end, True)) for ip, (s, last) in want.items()}
    for day in (86400, 20000, 10**9):
        got = reputation.fold(df, end, decay_hours=1, cycle_seconds=600, day_seconds=day).collect()
        assert {r.ip: r.score for r in got} == want
    assert {r.ip: r.notes for r in got}["x"] == "a; ab"  # "b" is contained in "ab"


def test_auth_lines(spark):
    lines = ["Accepted publickey for ann from 10.1.1.1 port 4001 ssh2", "Failed password for invalid user bob from 10.1.1.2 port 4002",
             "Failed password for root from fe80::1 port 4003 ssh2", "Invalid user eve from 10.1.1.4",
             "pam_unix: authentication failure; uid=0 rhost=10.1.1.5", "authentication failure; rhost=10.1.1.6  user=sam", "unrelated"]
    got = authlog.parse_lines(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "ts int, line string")).orderBy("ts").collect()
    assert [(r.src_ip, r.username, r.port, r.success) for r in got] == [
        ("10.1.1.1", "ann", 4001, True), ("10.1.1.2", "bob", 4002, False), ("fe80::1", "root", 4003, False),
        ("10.1.1.4", "eve", 22, False), ("10.1.1.5", "unknown", 22, False), ("10.1.1.6", "sam", 22, False)]


def test_feeds(spark, tmp_path):
    text = "# c\n; c\n// c\n\n 1.2.3.4/24 ; x\n5.6.7.8;y\nhost 9.9.9.9 bad\n300.1.1.1\n1.2.3.4\nnothing\n"
    (tmp_path / "list.txt").write_text(text)
    assert sorted(r.ip for r in feeds.read_lists(spark, str(tmp_path)).collect()) == ["1.2.3.4", "5.6.7.8", "9.9.9.9"]
    assert sorted(r.ip for r in feeds.read_lists(spark, str(tmp_path), strict=True).collect()) == ["1.2.3.4", "300.1.1.1", "5.6.7.8"]
    lines = feeds.lines_of(spark.createDataFrame([(1, "a\r\nb c\x0bd")], "doc int, t string"), "t").orderBy("line_no").collect()
    assert [r.value for r in lines] == ["a", "b", "c", "d"]
    page = spark.createDataFrame([("<head>1.1.1.1</head><body x>2.2.2.2<b>999.1.1.1</b><!-- 3.3.3.3 --></body>", "u")], "html string, url string")
    assert sorted(r.ip for r in feeds.parse_pages(page).collect()) == ["2.2.2.2", "999.1.1.1"]


def test_vulnerabilities(spark, tmp_path):
    catalogue = {"meta": {}, "products": {"VSFTPD": [{"cve": "C-1", "cvss": 9.8, "affected": "==2.3.4", "fixed": "2.3.5"}],
                 "apache httpd": [{"cve": "C-2", "cvss": 7.5, "affected": "==2.4.49"}, {"cve": "C-3", "cvss": 9.8, "affected": ">=2.4.49 <=2.4.50"},
                                  {"cve": "C-2", "cvss": 3.0, "affected": ""}, {"cve": "C-4", "cvss": None}]}}
    (tmp_path / "c.json").write_text(json.dumps(catalogue, indent=1))
    records = cves.read_catalogue(spark, str(tmp_path / "c.json"))
    nvd = {"vulnerabilities": [
        {"cve": {"id": "N-1", "descriptions": [{"lang": "es", "value": "no"}, {"lang": "en", "value": "yes"}],
                 "metrics": {"cvssMetricV30": [{"cvssData": {"baseScore": 5.0}}], "cvssMetricV2": [{"cvssData": {"baseScore": 9.0}}]}}},
        {"cve": {"id": "N-2", "descriptions": [], "metrics": {}}}]}
    online = cves.parse_nvd(spark.createDataFrame([("vsftpd", "2.3.4", json.dumps(nvd))], "product string, version string, value string"))
    got = {r.cve_id: r for r in online.collect()}
    assert (got["N-1"].cvss, got["N-1"].severity, got["N-1"].summary) == (5.0, "medium", "yes") and got["N-2"].severity == "none"
    banners = [("h1", 21, "220 (vsFTPd 2.3.4)"), ("h1", 22, "vsFTPd 3.0.5"), ("h2", 80, "Apache/2.4.49"), ("h3", 23, None), ("h3", 21, "Pure-FTPd")]
    services = spark.createDataFrame(banners, "host string, port int, banner string")
    matched = vulnerability.match(vulnerability.enrich(services), records.unionByName(online)).orderBy("host", "port")
    rows = {(r.host, r.port): r for r in vulnerability.with_risk(matched).collect()}
    ids = {k: [v.cve_id for v in r.vulnerabilities] for k, r in rows.items()}
    assert ids[("h1", 21)] == ["C-1"] and ids[("h1", 22)] == [] and ids[("h3", 23)] == []
    assert ids[("h2", 80)] == ["C-3", "C-2", "C-4"] and rows[("h2", 80)].vulnerabilities[1].cvss == 7.5
    assert rows[("h3", 23)].service == "telnet" and rows[("h3", 23)].label == "telnet" and rows[("h2", 80)].risk == "critical"
    nested = {r.host: r for r in vulnerability.nested_hosts(matched).collect()}
    assert [p.port for p in nested["h1"].ports] == [21, 22] and nested["h3"].risk == "none"
    counts = {r.severity: r.findings for r in vulnerability.severity_counts(vulnerability.findings(matched)).collect()}
    assert counts == {"critical": 2, "high": 1, "none": 1, "low": 0, "medium": 0}
    assert not vulnerability.gate(vulnerability.findings(matched.filter("host = 'h3'")), "low").first().blocked


def test_targets(spark):
    specs = spark.createDataFrame([(1, "192.168.1.0/30, 10.0.0.5-8"), (2, "10.0.0.8-10.0.0.6 name-x 10.0.0.9/32 10.0.1.4/31 my-host")],
                                  "spec_id int, spec string")
    got = [r.target for r in targets.expand(specs).orderBy("seq", "part", "host").collect()]
    assert got == ["192.168.1.1", "192.168.1.2", "10.0.0.5", "10.0.0.6", "10.0.0.7", "10.0.0.8", "name-x", "10.0.0.9", "10.0.1.4",
                   "10.0.1.5", "my-host"]
    six = targets.expand(spark.createDataFrame([(1, "2001:db8::f/126 ::1/128 bogus/77")], "spec_id int, spec string"))
    assert [r.target for r in six.orderBy("part", "host").collect()] == ["2001:db8::d", "2001:db8::e", "2001:db8::f", "::1"]
    assert targets.expand(spark.createDataFrame([(1, "10.0.0.0/14")], "spec_id int, spec string")).count() == 2**18 - 2


def test_target_ranges(spark):
    specs = spark.createDataFrame([(1, "2001:db8::/64 10.1.2.3/24 10.0.0.9-5 ::1 0.0.0.0/0 ::/0 2001:db8::/33"), (2, "10.0.0.0/99 10.0.0.1-300 2001::/129 x/8 name")],
                                  "spec_id int, spec string")
    got = [(r.low_key, r.high_key) for r in targets.ranges(specs).orderBy("seq", "part").collect()]
    six = "6:20010db8"
    assert got == [(six + "0" * 24, six + "0" * 8 + "f" * 16), ("4:0a010200", "4:0a0102ff"), ("4:0a000005", "4:0a000009"), ("6:" + "0" * 31 + "1",) * 2,
                   ("4:00000000", "4:ffffffff"), ("6:" + "0" * 32, "6:" + "f" * 32), (six + "0" * 24, six + "7" + "f" * 23)]
    assert [r.token for r in targets.rejected(specs).orderBy("part").collect()] == ["10.0.0.0/99", "10.0.0.1-300", "2001::/129", "x/8"]


def test_addresses_inside_ranges(spark):
    """The interval join against plain arithmetic, for ranges that begin and end anywhere."""
    import ipaddress
    import random

    from packetloom.functions.net import cidr_range, ip_key

    r = random.Random(2)
    four = [str(ipaddress.ip_address(r.choice([0, 167772160, 4294967040]) + r.randrange(700))) for _ in range(150)]
    six = [str(ipaddress.ip_address((0x20010DB8 << 96) + r.randrange(5000))) for _ in range(80)]
    keys = spark.createDataFrame([(i,) for i in {*four, *six}], "ip string").withColumn("key", ip_key(F.col("ip")))
    ranges = [(f"4:{a:08x}", f"4:{a + n:08x}") for a, n in ((167772160 + r.randrange(600), r.randrange(300)) for _ in range(12))]
    ranges += [cidr_range(c) for c in ("0.0.0.0/0", "255.255.255.0/25", "2001:db8::/117", "::/0", "10.0.0.7/32")]
    ranges += [(f"6:20010db8{a:024x}", f"6:20010db8{a + 777:024x}") for a in (3, 1000, 4095)]
    got = targets.inside(keys, spark.createDataFrame([(*x, i) for i, x in enumerate(ranges)], "low_key string, high_key string, n int"))
    known = {k["ip"]: k["key"] for k in keys.collect()}
    want = sorted((ip, n) for ip, key in known.items() for n, (low, high) in enumerate(ranges) if low <= key <= high)
    assert sorted((x["ip"], x["n"]) for x in got.collect()) == want
    names = targets.unlisted(spark.createDataFrame([(1, "2001:db8::/64 2001:db8::/100 10.0.0.0/8")], "spec_id int, spec string")).collect()
    assert [(n.token, n.reason) for n in names] == [("2001:db8::/64", "too many to list")]


def test_network_on_stored_keys_reaches_the_scan(spark, tmp_path):
    from packetloom.functions.net import key_in_net

    packets, _, _ = demo(spark)
    tables.append(packets, str(tmp_path), "packets")
    found = tables.read(spark, str(tmp_path), "packets").filter(key_in_net(F.col("src_key"), "45.0.0.0/8"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(src_key,4:2d000000)" in plan and "LessThanOrEqual(src_key,4:2dffffff)" in plan
    assert found.count() == 80 and tables.read(spark, str(tmp_path), "packets").filter(~key_in_net(F.col("src_key"), "45.0.0.0/8")).count() == packets.count() - 80


def test_stream_in_several_batches(spark, tmp_path):
    """State carries over micro-batches: the alerts equal those of one batch."""
    rows = [(i, 1000.0 + i * 0.5, "s", "d", i % 37) for i in range(600)]
    schema = "pkt_id long, ts double, src_ip string, dst_ip string, dst_port int"
    source, out = tmp_path / "in", str(tmp_path / "out")

    def run():
        stream = windows.with_event_time(spark.readStream.schema(schema).parquet(str(source)))
        alerts = stream_rules.trailing_distinct_alerts(stream, ["src_ip", "dst_ip"], "dst_port", 10.0, 20, 30.0)
        query = alerts.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()

    for part in range(3):
        spark.createDataFrame(rows[part * 200:(part + 1) * 200], schema).coalesce(1).write.mode("append").parquet(str(source))
        run()
    got = sorted((r.ts, r.n) for r in spark.read.parquet(out).collect())
    last, want = None, []
    for _, ts, _, _, _ in rows:
        n = len({r[4] for r in rows if ts - 10 <= r[1] <= ts})
        if n >= 20 and (last is None or ts - last >= 30):
            last = ts
            want.append((ts, n))
    assert got == want and len(want) > 5


def test_alert_sinks(spark, tmp_path):
    alerts = spark.createDataFrame(
        [(2.0, "high", "port-scan", "m", "a", None, {"n": "3"})],
        "ts double, severity string, rule string, message string, src string, dst string, evidence map<string,string>")
    totals = spark.createDataFrame([(7, 900)], "packets long, bytes long")
    document = tables.alert_document(totals, alerts, "file:x.pcap", None, 5.0).orderBy("part", "ts").collect()
    assert json.loads(document[0].json) == {"source": "file:x.pcap", "generated_at": 5.0, "packets": 7, "bytes": 900}
    assert json.loads(document[1].json)["evidence"] == {"n": "3"}
    tables.write_alert_lines(alerts, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).first().timestamp == "1970-01-01T00:00:02Z"


def test_reputation_of_one_address_over_many_cycles(spark):
    """Forty thousand events of one address, walked one by one; keeping all states in one list took minutes."""
    import time
    from packetloom.operators.reputation import advance

    events = spark.range(40_000).select(
        F.lit("a").alias("ip"), (F.floor(F.col("id") / 2) * 15.0 + F.floor(F.col("id") / 1000) * 90_000.0).alias("ts"), (F.col("id") % 2).cast("int").alias("seq"),
        (F.col("id") % 7).cast("int").alias("points"), F.concat(F.lit("n"), (F.col("id") % 3).cast("string")).alias("note"),
        F.when(F.col("id") % 9000 == 5, F.col("id") % 2 == 1).alias("blocklisted"))
    start = time.time()
    states, after = advance(events)
    got = {r["ts"]: (r["next_ts"], r["score"], r["blocklisted"], r["notes"]) for r in states.collect()}
    assert time.time() - start < 60
    rows = sorted(tuple(r) for r in events.select("ts", "seq", "points", "note", "blocklisted").collect())
    last, score, flag, notes, expected = None, 0, False, [], {}
    for ts, _, points, note, listed in rows:
        ticks = 0 if last is None else max(0, -int(-ts // 15) - 1 - int((last + 86400) // 15))
        score = min(100, max(score - 5 * ticks, 0) + points)
        flag = flag if listed is None else listed
        notes += [note] if note not in notes else []
        expected[ts], last = (score, flag, "; ".join(notes)), ts
    times = sorted(expected)
    assert got == {t: (n, *expected[t]) for t, n in zip(times, [*times[1:], None])}
    assert [tuple(r) for r in after.collect()] == [("a", score, times[0], last, flag, "; ".join(notes))]
