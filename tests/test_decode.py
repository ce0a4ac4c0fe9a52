import os
import struct

import pytest
from pyspark.sql import functions as F

import wire as w
from packetloom.operators import predicates as p
from packetloom.sources import capture, decode

A, B, R = "192.168.1.5", "192.168.1.10", "192.168.1.1"


def rows(spark, frames, linktype=1):
    schema = "frame_no long, ts double, raw binary, wire_length long, linktype long, file string"
    data = [(i, 1700000000.0 + i, bytearray(f), len(f), linktype, "f") for i, f in enumerate(frames)]
    df = decode.decode(spark.createDataFrame(data, schema))
    return [r for r in df.orderBy("frame_no").collect()]


@pytest.fixture(scope="module")
def many(spark):
    """Decode a mixed bag of frames in one job and look rows up by name."""
    options = struct.pack("!BBH", 2, 4, 1460) + bytes([1, 1]) + bytes([3, 3, 7]) + bytes(3)
    stamp = bytes([8, 10]) + struct.pack("!II", 4000000000, 5) + bytes([4, 2, 30, 3, 9, 0]) + bytes(2)
    post = b"POST /login HTTP/1.1\r\nHost: example.com\r\nX-A: 1\r\nx-a:  2 \r\nbroken\r\n\r\nuser=bob\tx\n"
    frames = {
        "options": w.ether(w.ipv4(A, B, 6, w.tcp(1234, 80, 2, options=options))),
        "stamp": w.ether(w.ipv4(A, B, 6, w.tcp(1234, 80, 2, options=stamp))),
        "psh": w.ether(w.ipv4(A, B, 6, w.tcp(1, 80, 24, b"hello world, this is data", seq=4000000001), ttl=53)),
        "udp": w.ether(w.ipv4(A, B, 17, w.udp(5000, 6000, b"payload"))),
        "udp_short": w.ether(w.ipv4(A, B, 17, w.udp(5000, 6000, b"payload", length=11))),
        "ping": w.ether(w.ipv4(A, B, 1, w.icmp(8, 0, 4660, 7, b"ping-data"))),
        "unreach": w.ether(w.ipv4(A, B, 1, w.icmp(3, 1, 0, 0, b"x"))),
        "query": w.ether(w.ipv4(A, R, 17, w.udp(5353, 53, w.dns_query(9, "www.example.com", 16, [("b.c", 255)])))),
        "reply": w.ether(w.ipv4(R, A, 17, w.udp(53, 5353, w.dns_response(1, "www.example.com", [
            w.dns_answer(1, bytes([1, 2, 3, 4])), w.dns_answer(28, bytes(15) + b"\1"),
            w.dns_answer(5, b"\1x\xc0\x10"), w.dns_answer(15, b"\0\5" + w.dns_name("mx.t")),
            w.dns_answer(16, b"\3abc\2de"), w.dns_answer(6, w.dns_name("s.t") + bytes(20)),
            w.dns_answer(33, struct.pack("!HHH", 1, 2, 443) + w.dns_name("srv.t")), w.dns_answer(99, b"\xab\xcd"),
            w.dns_answer(1, b"\1\2")])))),
        "dns_cut": w.ether(w.ipv4(A, R, 17, w.udp(5353, 53, w.dns_query(9, "www.example.com")[:-2]))),
        "dns_loop": w.ether(w.ipv4(A, R, 17, w.udp(5353, 53, struct.pack("!6H", 1, 0, 1, 0, 0, 0) + b"\1a\xc0\x0c\0\1\0\1"))),
        "dns_absurd": w.ether(w.ipv4(A, R, 17, w.udp(5353, 53, struct.pack("!6H", 1, 0, 65, 0, 0, 0) + b"\0\0\0\0\0"))),
        "dns_tcp": w.ether(w.ipv4(A, R, 6, w.tcp(5353, 53, 24, b"\0\x1d" + w.dns_query(3, "t.example")))),
        "post": w.ether(w.ipv4(A, B, 6, w.tcp(4000, 80, 24, post))),
        "status": w.ether(w.ipv4(B, A, 6, w.tcp(80, 4000, 24, b"HTTP/1.1 404 Not Found\r\nServer: nginx\r\n\r\n"))),
        "lf_only": w.ether(w.ipv4(A, B, 6, w.tcp(4000, 80, 24, b"GET /only/path\nHost: h\n\nbody"))),
        "get": w.ether(w.ipv4(A, B, 6, w.tcp(44000, 80, 24, b"GET / HTTP/1.1\r\nHost: x\r\n\r\n"))),
        "vlan": w.ether(w.ipv4(A, B, 17, w.udp(1, 2, b"z")), vlans=[(0x88A8, 0x3064), (0x8100, 7)]),
        "arp": w.ether(struct.pack("!HHBBH", 1, 0x800, 6, 4, 2) + w.MAC_A + bytes([10, 0, 0, 1]) + w.MAC_B + bytes([10, 0, 0, 2]), 0x0806),
        "arp_bad": w.ether(struct.pack("!HHBBH", 1, 0x800, 8, 4, 2) + bytes(30), 0x0806),
        "other": w.ether(b"lldp-data", 0x88CC),
        "fragment": w.ether(w.ipv4(A, B, 17, b"more data", frag=0x2003)),
        "gre": w.ether(w.ipv4(A, B, 47, b"tunnel")),
        "padded": w.ether(w.ipv4(A, B, 17, w.udp(1, 2, b"z")) + bytes(20)),
        "short": b"short",
        "ip_short": w.ether(b"\x45\0\0"),
        "tcp_short": w.ether(w.ipv4(A, B, 6, b"123456789")),
        "tcp_bad_head": w.ether(w.ipv4(A, B, 6, w.tcp(1, 2, 16, b"abc")[:12] + b"\xf0" + w.tcp(1, 2, 16, b"abc")[13:])),
        "v6": w.ether(w.ipv6("fe80::1", "2001:db8::2", 6, w.tcp(5, 6, 18, b"q")), 0x86DD),
        "v6_ext": w.ether(w.ipv6("::1", "::2", 0, bytes([60, 0]) + bytes(6) + bytes([17, 1]) + bytes(14) + w.udp(7, 8, b"e")), 0x86DD),
        "v6_frag": w.ether(w.ipv6("::1", "::2", 0, bytes([44, 3]) + bytes(6) + bytes([17, 2]) + bytes(22) + w.udp(7, 8, b"e")), 0x86DD),
    }
    return dict(zip(frames, rows(spark, frames.values()))), frames


def test_tcp(many):
    r = many[0]
    assert r["options"].tcp.options == ["mss=1460", "wscale=7"]
    assert (r["options"].tcp.sport, r["options"].tcp.dport, r["options"].tcp.flags) == (1234, 80, 2)
    assert r["stamp"].tcp.options == ["ts=4000000000/5", "sack-permitted", "opt-30"]
    assert r["psh"].ip.ttl == 53 and r["psh"].tcp.seq == 4000000001 and r["psh"].tcp.payload_length == 25
    assert bytes(r["psh"].payload) == b"hello world, this is data" and r["psh"].http is None
    assert r["tcp_bad_head"].tcp.header_length == 20 and bytes(r["tcp_bad_head"].payload) == b"abc"
    assert r["tcp_short"].errors == ["truncated TCP header"] and bytes(r["tcp_short"].payload) == b"123456789"


def test_udp_icmp(many):
    r = many[0]
    assert bytes(r["udp"].payload) == b"payload" and r["udp"].errors == []
    assert bytes(r["udp_short"].payload) == b"pay" and r["udp_short"].udp.payload_length == 3
    assert bytes(r["padded"].payload) == b"z"
    assert (r["ping"].icmp.ident, r["ping"].icmp.seq, bytes(r["ping"].payload)) == (4660, 7, b"ping-data")
    assert r["unreach"].icmp.ident is None and r["unreach"].icmp.payload_length == 5


def test_link_and_network(many):
    r = many[0]
    assert r["vlan"].eth.vlan == 0x64 and r["vlan"].eth.ethertype == 0x800 and r["vlan"].udp.sport == 1
    assert r["vlan"].eth.src == "aa:bb:cc:dd:ee:01" and r["vlan"].eth.dst == "aa:bb:cc:dd:ee:02"
    assert (r["arp"].arp.opcode, r["arp"].arp.sender_ip, r["arp"].arp.target_mac) == (2, "10.0.0.1", "aa:bb:cc:dd:ee:02")
    assert r["arp_bad"].arp is None and r["arp_bad"].errors == []
    assert bytes(r["other"].payload) == b"lldp-data"
    assert r["fragment"].errors == ["non-initial fragment"] and r["fragment"].udp is None
    assert r["fragment"].ip.frag_offset == 24 and r["fragment"].ip.flags == 1 and bytes(r["fragment"].payload) == b"more data"
    assert bytes(r["gre"].payload) == b"tunnel"
    assert r["short"].errors == ["truncated link header"] and r["short"].eth is None
    assert r["ip_short"].errors == ["truncated IP header"]
    assert (r["v6"].ip.src, r["v6"].ip.dst, r["v6"].ip.total_length) == ("fe80::1", "2001:db8::2", 61)
    assert r["v6"].tcp.flags == 18 and bytes(r["v6"].payload) == b"q"
    assert r["v6_ext"].udp.dport == 8 and r["v6_ext"].ip.header_length == 64
    # The next-header byte is taken first: a fragment header announced by hop-by-hop makes that one 8 bytes.
    assert r["v6_frag"].ip.header_length == 40 + 8 + 24 and r["v6_frag"].udp.dport == 8


def test_dns(many):
    r = many[0]
    assert [(q.name, q.qtype) for q in r["query"].dns.questions] == [("www.example.com", 16), ("b.c", 255)]
    assert not r["query"].dns.is_response and r["query"].dns.recursion_desired
    assert [a.data for a in r["reply"].dns.answers] == [
        "1.2.3.4", "::1", "x.example.com", "5 mx.t", "abc de", "soa s.t", "srv.t:443", "abcd", "0102"]
    assert r["reply"].dns.answers[0].ttl == 4000000000 and r["reply"].dns.answers[0].name == "www.example.com"
    assert r["dns_cut"].dns.questions == []
    assert r["dns_loop"].dns.questions[0].name == ".".join("a" * 9)
    assert r["dns_absurd"].dns is None
    assert r["dns_tcp"].dns.questions[0].name == "t.example"


def test_http(many):
    r = many[0]
    post = r["post"].http
    assert (post.kind, post.method, post.path, post.version) == ("request", "POST", "/login", "HTTP/1.1")
    assert post.headers == {"host": "example.com", "x-a": "2"} and post.body_length == 11
    assert post.body_preview == "user=bob.x."
    status = r["status"].http
    assert (status.kind, status.status, status.reason, status.version) == ("response", 404, "Not Found", "HTTP/1.1")
    lf = r["lf_only"].http
    assert (lf.path, lf.version, lf.headers, lf.body_length) == ("/only/path", "HTTP/1.0", {"host": "h"}, 4)


def flat(spark, frames):
    schema = "frame_no long, ts double, raw binary, wire_length long, linktype long, file string"
    data = [(i, 1700000000.0 + i, bytearray(f), len(f), 1, "f") for i, f in enumerate(frames)]
    return decode.flatten(decode.decode(spark.createDataFrame(data, schema)))


def test_labels_and_summaries(spark, many):
    names = ["query", "post", "psh", "udp", "ping", "arp", "gre", "other", "short", "reply", "status"]
    got = flat(spark, [many[1][n] for n in names]).select("pkt_id", "protocol", decode.summary().alias("s")).orderBy("pkt_id").collect()
    assert [g.protocol for g in got] == ["DNS", "HTTP", "TCP", "UDP", "ICMP", "ARP", "GRE", "ETH-0x88cc", "UNKNOWN", "DNS", "HTTP"]
    assert [g.s for g in got] == [
        "192.168.1.5:5353 > 192.168.1.1:53 DNS query TXT www.example.com",
        "192.168.1.5:4000 > 192.168.1.10:80 HTTP POST example.com/login",
        "192.168.1.5:1 > 192.168.1.10:80 TCP [PSH|ACK] seq=4000000001 win=512 len=25",
        "192.168.1.5:5000 > 192.168.1.10:6000 UDP len=7",
        "192.168.1.5 > 192.168.1.10 ICMP echo-request id=4660 len=9",
        "ARP reply 10.0.0.1 -> 10.0.0.2",
        "192.168.1.5 > 192.168.1.10 GRE len=40",
        "aa:bb:cc:dd:ee:01 > aa:bb:cc:dd:ee:02 ETH-0x88cc len=23",
        "? > ? UNKNOWN len=5",
        "192.168.1.1:53 > 192.168.1.5:5353 DNS response A www.example.com -> 1.2.3.4,::1,x.example.com",
        "192.168.1.10:80 > 192.168.1.5:4000 HTTP 404 Not Found",
    ]


FILTERS = [
    (lambda: p.proto("tcp"), "TFF"), (lambda: p.proto("udp"), "FTF"), (lambda: p.proto("icmp"), "FFT"),
    (lambda: p.proto("dns"), "FTF"), (lambda: p.proto("http"), "TFF"), (lambda: p.proto("ip"), "TTT"),
    (lambda: p.proto("ip6") | p.proto("arp"), "FFF"), (lambda: p.proto("tcp") | p.proto("icmp"), "TFT"),
    (lambda: ~p.proto("tcp"), "FTT"), (lambda: p.proto("udp") & p.port(53), "FTF"),
    (lambda: (p.proto("tcp") | p.proto("udp")) & ~p.proto("http"), "FTF"), (lambda: p.host(B), "TFT"),
    (lambda: p.host(R, "dst"), "FTF"), (lambda: p.net("192.168.1.0/24"), "TTT"), (lambda: p.net("bogus/99"), "FFF"),
    (lambda: p.port(80, "dst"), "TFF"), (lambda: p.portrange(50, 100), "TTF"), (lambda: p.tcp_flag("psh"), "TFF"),
    (lambda: p.tcp_flag("nope"), "FFF"), (lambda: ~p.tcp_flag("psh"), "FTT"), (lambda: p.length(">", 1000), "FFF"),
    (lambda: p.payload_contains("example.com"), "FFF"), (lambda: p.payload_contains("get"), "TFF"),
    (lambda: p.everything(), "TTT"),
]


def test_filters(spark):
    frames = [
        w.ether(w.ipv4(A, B, 6, w.tcp(44000, 80, 24, b"GET / HTTP/1.1\r\nHost: x\r\n\r\n"))),
        w.ether(w.ipv4(A, R, 17, w.udp(5353, 53, w.dns_query(2, "a.example.com")))),
        w.ether(w.ipv4(A, B, 1, w.icmp(8, 0, 1, 1, b"x" * 40))),
    ]
    checks = [make().alias(f"c{i}") for i, (make, _) in enumerate(FILTERS)]
    got = flat(spark, frames).select("pkt_id", *checks).orderBy("pkt_id").collect()
    for i, (_, expected) in enumerate(FILTERS):
        assert "".join("T" if r[f"c{i}"] else "F" for r in got) == expected, i


def test_other_links(spark):
    sll = struct.pack("!HHH8sH", 0, 1, 6, w.MAC_A + b"\0\0", 0x800) + w.ipv4(A, B, 17, w.udp(1, 2, b"z"))
    assert rows(spark, [sll], 113)[0].eth.src == "aa:bb:cc:dd:ee:01"
    null = struct.pack("<I", 30) + w.ipv6("::1", "::2", 58, w.icmp(128, 0, 5, 6, b"v"))
    got = rows(spark, [null], 0)[0]
    assert got.eth.ethertype == 0x86DD and got.icmp.seq == 6
    got = rows(spark, [w.ipv4(A, B, 17, w.udp(1, 2, b"z")), b""], 101)
    assert got[0].eth is None and got[0].udp.dport == 2 and got[1].errors == []
    assert rows(spark, [b"abc"], 147)[0].errors == ["unsupported linktype 147"]


def test_flat_headers_equal_the_decoded_layers(spark):
    """Whole, cut and random frames of all link types; tags, options, fragments and extension headers."""
    import random

    from packetloom.sources import headers

    r = random.Random(11)
    bodies = [(6, w.tcp(1, 80, 18, b"abc", options=bytes([2, 4, 5, 180]))), (17, w.udp(53, 4000, b"xyz")), (1, w.icmp(8, 0, 1, 2)), (58, w.icmp(129, 0, 1, 2)), (47, b"gre")]
    whole = []
    for proto, body in bodies:
        for frag in (0, 0x2000, 5, 0x4000):
            whole.append((1, w.ether(w.ipv4(A, B, proto, body, frag=frag))))
            whole.append((101, w.ipv4(A, B, proto, body, options=bytes(8), total=r.choice([None, 0, 21, 9999]))))
        for chain in ((), (0,), (0, 43), (44,), (60, 44), (43, 44, 60)):
            inner, following = body, proto
            for kind in reversed(chain):
                inner, following = bytes([following, r.choice([0, 0, 1])] + [0] * r.choice([6, 14])) + inner, kind
            whole.append((1, w.ether(w.ipv6("2001:db8::1", r.choice(["::ffff:1.2.3.4", "::5.6.7.8", "fe80::", "1:0:0:2::3"]), following, inner), ethertype=0x86DD,
                                     vlans=[(0x8100, 7), (0x88A8, 4095)][:r.randrange(3)])))
    arp = bytes.fromhex("0001080006040001") + bytes(range(20))
    whole += [(1, w.ether(arp, ethertype=0x0806)), (1, w.ether(b"", vlans=[(0x8100, 5)])), (113, bytes(14) + b"\x08\x00" + w.ipv4(A, B, 6, bodies[0][1])), (113, bytes(16)),
              (0, b"\x1e\0\0\0" + w.ipv6("::1", "::2", 17, bodies[1][1])), (0, b"\x02\0\0\0" + w.ipv4(A, B, 17, bodies[1][1])), (147, b"abcd"), (101, b""), (1, None)]
    frames = list(whole)
    for kind, raw in whole:
        frames += [(kind, raw[:r.randrange(len(raw) + 1)]) for _ in range(4) if raw]
        if raw:
            bent = bytearray(raw)
            for _ in range(3):
                bent[r.randrange(len(bent))] = r.randrange(256)
            frames.append((kind, bytes(bent)))
    frames += [(r.choice([0, 1, 101, 113]), bytes(r.randrange(256) for _ in range(r.randrange(70)))) for _ in range(300)]
    df = spark.createDataFrame([(i, float(i), raw, 60, kind) for i, (kind, raw) in enumerate(frames)], "pkt_id bigint, ts double, raw binary, wire_length bigint, linktype bigint")
    shared = ["pkt_id", "ethertype", "ip_version", "src_ip", "dst_ip", "src_port", "dst_port", "transport", "tcp_flags", "icmp_type"]
    nested = decode.flatten(decode.decode(df, ("link", "network", "transport"))).select(*shared, F.col("eth.vlan").alias("vlan"), F.col("ip.proto").alias("ip_proto"))
    got = headers.flat(df, (*shared[1:], "vlan", "ip_proto")).select(*nested.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, nested.collect()))
    assert headers.flat(df, ("ethertype",)).columns == ["pkt_id", "ts", "wire_length", "ethertype"]


def test_capture_files(spark, tmp_path):
    frames = [w.ether(w.ipv4(A, B, 6, w.tcp(i, 80, 2, b"x" * i))) for i in range(1, 400)]
    records = [(1700000000 + i, 250000, f, len(f) + 5) for i, f in enumerate(frames)]
    (tmp_path / "little.pcap").write_bytes(w.pcap(records))
    (tmp_path / "big.pcap").write_bytes(w.pcap([(5, 500000000, frames[0], 60)], ">", nano=True))
    (tmp_path / "cut.pcap").write_bytes(w.pcap(records[:3])[:-1])
    (tmp_path / "bad.pcap").write_bytes(b"not a pcap file at all, really")
    (tmp_path / "ng.pcap").write_bytes(bytes.fromhex("0a0d0d0a") + bytes(40))
    (tmp_path / "tiny.pcap").write_bytes(b"abc")
    for split in (1 << 26, 1000):
        got = capture.read_frames(spark, str(tmp_path), split).withColumn("name", F.substring_index("file", "/", -1))
        by = {}
        for r in got.orderBy("name", "frame_no").collect():
            by.setdefault(r["name"], []).append(r)
        assert [bytes(r.raw) for r in by["little.pcap"]] == frames
        assert [r.frame_no for r in by["little.pcap"]] == list(range(399))
        assert by["little.pcap"][1].ts == 1700000001.25 and by["little.pcap"][0].wire_length == len(frames[0]) + 5
        assert by["big.pcap"][0].ts == 5.5 and len(by["cut.pcap"]) == 2 and set(by) == {"little.pcap", "big.pcap", "cut.pcap"}
    rejected = {os.path.basename(r.file): r.reason for r in capture.rejected_files(spark, str(tmp_path)).collect()}
    assert set(rejected) == {"bad.pcap", "ng.pcap", "tiny.pcap"} and "pcapng" in rejected["ng.pcap"]


def test_captures_with_payloads_that_look_like_headers(spark, tmp_path):
    """Ranges that begin inside a payload full of plausible records are found out and read again."""
    fake = w.pcap([(1700000000 + k, 5, bytes(10), 10) for k in range(30)])[24:]
    frames = [bytes([i % 256] * (i % 50)) + (fake if i % 3 == 0 else b"") + bytes(i % 7) for i in range(200)]
    frames[120] = bytes(9000)  # longer than several ranges
    (tmp_path / "fake.pcap").write_bytes(w.pcap([(1700000000 + i, 7, f, len(f) + 1) for i, f in enumerate(frames)]))
    (tmp_path / "far.pcap").write_bytes(w.pcap([(1 + i * 10_000_000, 7, f, 0) for i, f in enumerate(frames[:40])]))  # never plausible
    for split in (700, 4096, 1 << 20):
        got = capture.read_frames(spark, str(tmp_path), split).orderBy("file", "frame_no").collect()
        by = lambda name: [(r.frame_no, bytes(r.raw)) for r in got if r.file.endswith(name)]
        assert by("fake.pcap") == list(enumerate(frames))
        assert by("far.pcap") == list(enumerate(frames[:40]))


def test_layers_cost_only_what_is_asked_for(spark):
    frames = spark.createDataFrame([(0.0, b"\x00" * 14, 14, 1, 1)], "ts double, raw binary, wire_length bigint, linktype bigint, pkt_id bigint")
    link = decode.flatten(decode.decode(frames, ("link",))).select("ethertype")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in link and "mss=" not in link and "HTTP/" not in link
    heads = decode.flatten(decode.decode(frames, ("link", "network", "transport"))).select("tcp_flags")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in heads and "HTTP/" not in heads
    assert decode.decode(frames, ("link",)).schema["dns"].dataType.simpleString() == decode.decode(frames).schema["dns"].dataType.simpleString()
