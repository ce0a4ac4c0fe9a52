"""Work and memory of one task: what must not grow with the input."""

import glob
import ipaddress
import random
import struct

from pyspark.sql import functions as F

import wire
from packetloom.functions import net
from packetloom.plans import storage, streams
from packetloom.session import deal
from packetloom.sources import capture, decode
from packetloom.streaming import store


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_small_ranges_share_a_task(spark, tmp_path):
    records = b"".join(struct.pack("<IIII", 1700000000 + i, i, 40, 40) + bytes([i % 251]) * 40 for i in range(2000))
    (tmp_path / "a.pcap").write_bytes(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + records)
    ranges, tasks = capture.file_ranges(spark, f"file://{tmp_path}/*.pcap", split_bytes=1024)
    assert ranges.count() > 100 and tasks <= spark.sparkContext.defaultParallelism
    frames = capture.read_frames(spark, f"file://{tmp_path}/*.pcap", split_bytes=1024)
    assert sorted((r.frame_no, r.ts) for r in frames.select("frame_no", "ts").collect()) == [(i, 1700000000 + i + i / 1e6) for i in range(2000)]


def test_tcp_options_are_found_in_one_pass(spark):
    def texts(data):
        out, at = [], 0
        while at < len(data) and data[at]:
            kind = data[at]
            if kind == 1:
                at += 1
                continue
            size = data[at + 1] if at + 1 < len(data) else 0
            if size < 2 or at + size > len(data):
                break
            body = data[at + 2:at + size]
            number = int.from_bytes(body, "big")
            known = {2: "mss", 3: "wscale"}.get(kind) if (kind, size) in ((2, 4), (3, 3)) else None
            stamps = f"ts={int.from_bytes(body[:4], 'big')}/{int.from_bytes(body[4:], 'big')}" if (kind, size) == (8, 10) else None
            out.append(f"{known}={number}" if known else stamps or decode.TCP_OPTIONS.get(kind, f"opt-{kind}"))
            at += size
        return out

    r = random.Random(5)
    blocks = [bytes(r.choice([0, 1, 1, 2, 3, 3, 4, 4, 8, 10, 34, 40, 41, 255]) for _ in range(r.randrange(1, 41))) for _ in range(3000)]
    blocks += [bytes.fromhex("020405b40103030701010402080a0000000a00000014"), bytes([5, 40]) + bytes(38)]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blocks)], "i int, d binary").select("i", decode._tcp_options(F.col("d")).alias("o"))
    assert {x.i: x.o for x in df.collect()} == {i: texts(b) for i, b in enumerate(blocks)}
    assert "aggregate(" not in _plan(df)


def test_ipv6_text_is_made_once(spark):
    r = random.Random(6)
    raws = [b"".join(r.choice([b"\0\0", b"\0\1", bytes([0, r.randrange(256)]), r.randbytes(2)]) for _ in range(8)) for _ in range(2000)]
    raws = [x for x in raws if x[:10] != bytes(10)]  # those with an embedded IPv4 address are tested elsewhere
    df = spark.createDataFrame([(bytearray(x),) for x in raws], "d binary").select("d", net.ipv6_text(F.col("d")).alias("t"))
    assert all(x.t == str(ipaddress.IPv6Address(bytes(x.d))) for x in df.collect())
    assert "sequence" not in _plan(df)


def test_tasks_grow_with_the_files_read(spark, tmp_path):
    spark.range(50_000).select((F.col("id") % 1000).alias("k"), F.rand(1).alias("x")).write.parquet(f"file://{tmp_path}/t")
    df = spark.read.parquet(f"file://{tmp_path}/t")
    assert deal(df, "k", task_bytes=10_000).rdd.getNumPartitions() > 30
    assert deal(df, "k").groupBy("k").count().count() == 1000


def test_a_stretch_of_a_replay_is_written_by_several_tasks(spark):
    rows = spark.range(0, 6000, numPartitions=4).select((F.col("id") % 601).cast("double").alias("ts"), "id")
    root = streams.replay(rows, lambda s: s.drop("event_time"), start=lambda out, root: out.writeStream.format("parquet").option("path", f"{root}/out"))
    folder = root.removeprefix("file://")
    assert len(glob.glob(f"{folder}/in/*.parquet")) > 2 * streams.STRETCHES
    assert spark.read.parquet(f"{root}/out").agg(F.count("id"), F.count_distinct("id")).first() == (6000, 6000)


def test_a_period_is_not_one_file_of_every_task(spark, tmp_path):
    rows = spark.range(0, 8000, numPartitions=8).select((F.col("id") % 20 * 3600.0).alias("ts"), "id")
    store.put(rows, f"file://{tmp_path}", "t", 0)
    assert len(glob.glob(f"{tmp_path}/t/period=*/batch=0/*.parquet")) == 20
    assert store.whole(spark, f"file://{tmp_path}", "t", "ts double, id bigint").count() == 8000


def test_fixed_headers_are_read_in_one_step(spark):
    raw = wire.ether(wire.ipv4("10.0.0.1", "10.0.0.2", 6, wire.tcp(4000, 443, 18, b"abc", options=bytes([2, 4, 5, 180]), seq=4000000000)), vlans=[(0x8100, 100)])
    frames = spark.createDataFrame([(1, 0.0, raw, len(raw), 1), (2, 1.0, raw[:40], 60, 1), (3, 2.0, None, 60, None)],
                                   "pkt_id int, ts double, raw binary, wire_length bigint, linktype bigint")
    rows = decode.decode(frames, ("link", "network", "transport"))
    assert _plan(rows).count("MapInArrow") == 1 and _plan(rows).count("Generate inline") <= 2
    assert "conv(" not in _plan(decode.decode(frames, ("link", "network")))
    whole, cut, nothing = rows.orderBy("pkt_id").collect()
    assert (whole.eth.vlan, whole.ip.src, whole.tcp.seq, whole.tcp.options, bytes(whole.payload)) == (100, "10.0.0.1", 4000000000, ["mss=1460"], b"abc")
    assert (cut.tcp, cut.errors, len(cut.payload)) == (None, ["truncated TCP header"], 2)
    assert (nothing.eth, nothing.ip, nothing.errors, bytes(nothing.payload)) == (None, None, [], b"")


def test_halves_are_told_apart_without_texts(spark):
    rows = spark.range(1000).select(
        F.col("id").cast("double").alias("ts"), F.concat(F.lit("10.0.0."), F.col("id") % 8).alias("src_ip"), F.concat(F.lit("10.0.1."), F.col("id") % 9).alias("dst_ip"),
        (F.col("id") % 7).cast("int").alias("src_port"), F.lit(None).cast("int").alias("dst_port"), F.concat(F.lit("T"), F.col("id") % 2).alias("protocol"),
        F.lit(40).alias("length"), F.lit(None).cast("string").alias("flags"))
    first, second = storage.halves(rows, "packets")
    assert all("concat" not in line for half in (first, second) for line in _plan(half).splitlines() if "Filter" in line)
    assert sorted(map(str, first.union(second).collect())) == sorted(map(str, rows.collect()))
    assert 300 < first.count() < 700


def test_answers_are_read_without_the_other_layers(spark):
    raw = wire.ether(wire.ipv4("10.0.0.1", "10.0.0.2", 17, wire.udp(53, 5353, wire.dns_response(1, "a.example", [wire.dns_answer(1, bytes([1, 2, 3, 4]))]))))
    frames = spark.createDataFrame([(1, 0.0, raw, len(raw), 1)], "pkt_id int, ts double, raw binary, wire_length bigint, linktype bigint")
    rows = decode.decode(frames, ("link", "network", "transport", "dns")).select("pkt_id", "dns.is_response", F.explode("dns.answers").alias("a"))
    assert [tuple(r) for r in rows.select("pkt_id", "is_response", "a.name", "a.data").collect()] == [(1, True, "a.example", "1.2.3.4")]
