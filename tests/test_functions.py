import ipaddress
import os
import socket

from pyspark.sql import functions as F

from packetloom.functions import labels, net, severity, text, versions


def column(spark, values, kind, **exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    rows = df.select("i", *[e(F.col("x")).alias(n) for n, e in exprs.items()]).orderBy("i").collect()
    return {n: [r[n] for r in rows] for n in exprs}


def test_address_keys(spark):
    ips = ["10.0.0.1", "010.0.0.1", "256.1.1.1", "::1", "fe80::1", "2001:db8::1:0:0:1", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8",
           "1:2:3:4:5:6:7::", "1::2::3", ":::", "fe80::1%eth0", "224.0.0.1", "255.255.255.255", "0.0.0.0", "x", "::", None,
           "1:2:3:4:5:6:7:8:9", "172.16.5.4", "172.32.0.1", "100.64.0.9", "ff02::1", "fd00::1", "1.2.3", "1:2:3:4:5:6:7"]

    def parsed(ip):
        try:
            return ipaddress.ip_address(ip)
        except ValueError:
            return None

    got = column(spark, ips, "string", key=net.ip_key, private=net.is_private, inside=lambda c: net.in_net(c, "fe80::9/10"),
                 v4=lambda c: net.in_net(c, "172.16.77.1/12"), bad=lambda c: net.in_net(c, "1.2.3.4/99"))
    internal = [ipaddress.ip_network(n) for n in net.INTERNAL_NETWORKS]
    for i, ip in enumerate(ips):
        a = parsed(ip)
        assert got["key"][i] == (a and f"{a.version}:{int(a):0{8 if a.version == 4 else 32}x}"), ip
        assert got["private"][i] == bool(a and (a.is_multicast or any(a in n for n in internal if n.version == a.version))), ip
        assert got["inside"][i] == bool(a and a.version == 6 and a in ipaddress.ip_network("fe80::/10")), ip
        assert got["v4"][i] == bool(a and a.version == 4 and a in ipaddress.ip_network("172.16.0.0/12")), ip
        assert got["bad"][i] is False


def test_ipv6_text(spark):
    raws = [socket.inet_pton(socket.AF_INET6, x) for x in (
        "::1", "::", "fe80::1", "2001:db8::1:0:0:1", "2001:0:0:1::", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "::1.2.3.4", "0:1::",
        "1:0:2:3:4:5:6:7", "1:0:0:2:0:0:0:3", "0:0:1::2", "1:2:3:4:5:6:0:0", "::1:2", "10:0:0:100::")] + [os.urandom(16) for _ in range(20)]
    got = column(spark, [bytearray(r) for r in raws], "binary", t=net.ipv6_text)["t"]
    assert got == [socket.inet_ntop(socket.AF_INET6, r) for r in raws]


def test_names(spark):
    assert column(spark, ["a.b.example.com", "example.com", "localhost", "", ".x..y.z."], "string", d=net.base_domain)["d"] == [
        "example.com", "example.com", "localhost", "", "y.z"]
    flags = column(spark, [0, 2, 24, 41, 194, None], "int", long=labels.flag_text, short=labels.monitor_flag_text, scan=labels.scan_signature)
    assert flags["long"] == ["NONE", "SYN", "PSH|ACK", "FIN|PSH|URG", "SYN|ECE|CWR", None]
    assert flags["short"][4] == "SYN" and flags["scan"] == ["NULL scan", None, None, "XMAS scan", None, None]
    scans = column(spark, [1, 3, 7, 32, 33, 64, 65], "int", s=labels.scan_signature)["s"]
    assert scans == ["FIN scan", "SYN+FIN scan", "SYN+FIN scan", "URG probe", "URG probe", "NULL scan", "FIN scan"]
    codes = column(spark, [6, 47, 200], "int", ip=labels.ip_protocol_name, mon=labels.monitor_protocol_name, icmp=labels.icmp_type_name,
                   dns=labels.dns_type_name, rcode=labels.dns_rcode_name, arp=labels.arp_operation_name)
    assert codes["ip"] == ["TCP", "GRE", "IP-200"] and codes["mon"] == ["TCP", "47", "200"]
    assert codes["icmp"][2] == "type-200" and codes["dns"] == ["SOA", "47", "200"] and codes["rcode"][2] == "200" and codes["arp"][0] == "6"
    texts = column(spark, ["SYN", "SYN|ACK", "FIN|SYN", None], "string", s=labels.syn_only_text)["s"]
    assert texts == [True, False, True, False]


def test_text(spark):
    entropy = column(spark, [bytearray(b""), bytearray(b"aaaaaaaa"), bytearray(range(256))], "binary", e=text.bytes_entropy)["e"]
    assert entropy[0] == 0.0 and entropy[1] == 0.0 and abs(entropy[2] - 8.0) < 1e-9
    sizes = column(spark, [0.0, 1023.0, 1536.0, 5.0 * 2**30, 2.0**60], "double", s=text.human_bytes, r=text.human_rate)
    assert sizes["s"] == ["0B", "1023B", "1.5KB", "5.0GB", "1024.0PB"] and sizes["r"][1] == "1023B/s"
    times = column(spark, [1700000000.1239, 1700000000.0, 1700000000.5], "double", c=text.clock_text, iso=text.iso_time,
                   b=lambda c: text.bucket_millis(c, 300))
    assert times["c"][0] == "22:13:20.123" and times["iso"] == [
        "2023-11-14T22:13:20.123900Z", "2023-11-14T22:13:20Z", "2023-11-14T22:13:20.500000Z"]
    assert times["b"][0] == 1699999800000
    assert column(spark, [bytearray(b"ab\x00c\xff d\n\t")], "binary", p=text.payload_preview)["p"] == ["ab.c� d.\t"]
    assert column(spark, ["x\r\ny", "z"], "string", f=text.first_line)["f"] == ["x", "z"]


def test_versions(spark):
    pairs = [("2.4.51", "2.4.49", 1), ("1.2.3", "1.10.0", -1), ("7.2p2", "7.2", 1), ("7.2p2", "7.7", -1), ("1.3.5", "1.3.5a", -1), ("1.0", "1.0", 0)]
    df = spark.createDataFrame(pairs, "a string, b string, want int")
    a, b = versions.version_key(F.col("a")), versions.version_key(F.col("b"))
    assert df.filter(F.when(a > b, 1).when(a < b, -1).otherwise(0) != F.col("want")).count() == 0
    cases = [("2.4.50", ">=2.4.49 <=2.4.50", True), ("1.0.1f", ">=1.0.1 <1.0.1g", True), ("8.0", "<7.7", False), ("1", "", True),
             ("", ">1", False), (None, "", False), ("1.0", "> 1.0", True), ("1", "1,!=2", True), ("2.4.50", "<", True), ("2", "=2", True)]
    df = spark.createDataFrame(cases, "v string, c string, want boolean")
    assert df.filter(versions.satisfies(F.col("v"), F.col("c")) != F.col("want")).count() == 0
    banners = ["SSH-2.0-OpenSSH_7.2p2 Ubuntu", "220 (vsFTPd 2.3.4)", "Server: Apache/2.4.49 (Unix)", "nginx/1.4.0", "gibberish", None,
               "220 Pure-FTPd", "Samba 4.6.3", "5.5.5-10.1.2-MariaDB"]
    got = column(spark, banners, "string", p=versions.identify_product, q=lambda c: versions.identify_product(c, True))
    assert [p and (p.product, p.version) for p in got["p"]] == [
        ("OpenSSH", "7.2p2"), ("vsftpd", "2.3.4"), ("Apache httpd", "2.4.49"), ("nginx", "1.4.0"), None, None, ("Pure-FTPd", None),
        ("MySQL", "4.6.3"), ("MariaDB", "5.5.5-10.1.2"[6:])]
    assert got["q"][7].product == "Samba"
    scores = column(spark, [9.8, 7.5, 5.0, 1.0, 0.0], "double", s=severity.cvss_severity)["s"]
    assert scores == ["critical", "high", "medium", "low", "none"]
    assert column(spark, ["critical", "odd"], "string", r=severity.monitor_rank)["r"] == [4, 2]
