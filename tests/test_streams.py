"""Streams: late and shuffled rows, restarts, bounded state, growing logs."""

import os
import random

from pyspark.sql import functions as F

from packetloom.operators import rules
from packetloom.operators.cooldown import cooldown
from packetloom.sources import authlog
from packetloom.streaming import held, store, windows

SCHEMA = "pkt_id bigint, ts double, src_ip string, dst_ip string, dst_port int, tcp_flags int, length int"


def _rows():
    """Bursts of SYNs from two sources, and one row far in the future that lets the watermark pass."""
    r = random.Random(4)
    rows = [(i, 1000.0 + i * 0.25, f"10.0.0.{i % 3}", f"192.168.1.{r.randrange(12)}", r.randrange(1, 9), 2, r.randrange(60, 1500)) for i in range(900)]
    return rows + [(9999, 90000.0, "10.0.0.0", "192.168.1.1", 1, 2, 60)]


def _stream(spark, folder, batches, rule, root):
    source = f"{folder}/in"
    for part in batches:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = windows.with_event_time(spark.readStream.schema(SCHEMA).parquet(source))
        (held.whole_slices(stream, rule).writeStream.foreachBatch(held.alert_sink(root, rule, 30.0))
         .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination())
    out = store.whole(spark, root, "alerts", "pkt_id bigint, ts double, src string, dst string, evidence map<string,string>")
    return sorted((r.ts, r.src, r.dst, tuple(sorted(r.evidence.items()))) for r in out.collect())


def test_alerts_do_not_depend_on_how_rows_arrive(spark, tmp_path):
    """One batch, many batches and rows up to 40 s late give the alerts of the batch rule; restarts included."""
    rows = _rows()
    egress = rules.Trailing(rules.syn_only, ("src_ip", "dst_ip"), 20.0, 2500, rules.data_egress_rule().alerts, amount="length", out="bytes")
    for k, rule in enumerate((rules.syn_flood_rule(count=2), rules.host_sweep_rule(hosts=9), egress)):
        want = sorted((r.ts, r.src, r.dst, tuple(sorted(r.evidence.items()))) for r in rule.fire(
            spark.createDataFrame(rows[:-1], SCHEMA), 30.0).collect())
        assert len(want) > 5
        late = sorted(rows[:-1], key=lambda r: r[1] + random.Random(r[0]).random() * 40)
        cuts = [late[i:i + 300] for i in range(0, 900, 300)] + [rows[-1:]]
        for name, batches in (("one", [rows]), ("late", cuts)):
            # in one batch the watermark passes only at the batch's end, so everything is in time
            assert _stream(spark, f"{tmp_path}/{k}{name}", batches, rule, f"{tmp_path}/{k}{name}/out") == want


def test_kept_table_reads_a_bounded_number_of_files(spark, tmp_path):
    """200 batches change a keyed table; what a batch reads does not grow, and repeating a batch changes nothing."""
    table = store.Kept(spark, str(tmp_path / "t"), ["k"], "k int, v int", every=8)
    made = [spark.createDataFrame([(i, 0)], "k int, v int").coalesce(1) for i in range(3)]
    want, reads = {}, []
    for n in range(200):
        rows = made[n % 3].withColumn("v", F.lit(n))
        for _ in range(2 if n % 50 == 7 else 1):
            table.compact(n)
            table.change(n, rows)
        want[n % 3] = n
        snapshots, changes = table._sources(n + 1)
        reads.append(len(snapshots) + len(changes))
        if n in (0, 5, 9, 17, 100, 199):
            assert {r.k: r.v for r in table.before(n + 1).collect()} == want
    assert max(reads) <= 10
    assert len(os.listdir(tmp_path / "t" / "changes")) <= 20 and len(os.listdir(tmp_path / "t" / "snapshot")) <= 3


def test_recent_reads_only_the_periods_asked_for(spark, tmp_path):
    root = str(tmp_path)
    for n in range(5):
        store.put(spark.createDataFrame([(n * store.PERIOD + 5.0, n), (n * store.PERIOD + 3500.0, n)], "ts double, v int").coalesce(1), root, "t", n)
    got = store.recent(spark, root, "t", "ts double, v int", 2 * store.PERIOD + 100, 3 * store.PERIOD + 100, 99)
    assert sorted((r.ts, r.v) for r in got.collect()) == [(2 * 3600 + 3500.0, 2), (3 * 3600 + 5.0, 3)]
    assert len(got.inputFiles()) == 2
    assert store.recent(spark, root, "t", "ts double, v int", 0, 1e9, 3).count() == 6
    store.purge(spark, root, "t", 2 * store.PERIOD)
    assert store.whole(spark, root, "t", "ts double, v int").count() == 6


def test_a_period_is_one_file_in_streams_with_state(spark, tmp_path):
    """Streams with state run without adaptive execution, which the dealing by period must not need (F2)."""
    rows = spark.range(0, 4000, 1, 16).select((F.col("id") % 20 * store.PERIOD + F.col("id") % 7).alias("ts"), "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        store.put(rows, str(tmp_path), "t", 0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len([f for _, _, files in os.walk(tmp_path) for f in files if f.endswith(".parquet")]) == 20
    assert store.whole(spark, str(tmp_path), "t", "ts double, id bigint").count() == 4000


def test_a_long_batch_goes_to_a_few_wide_folders(spark, tmp_path):
    root, hour, schema = str(tmp_path), store.PERIOD, "ts double, v int"
    store.put(spark.createDataFrame([(5.0, 0), (hour + 5.0, 1)], schema), root, "t", 0, span=(5.0, hour + 5.0))
    long = [(h * hour + 7.0, h) for h in range(3000)]
    for _ in range(2):  # a repeated batch replaces itself
        store.put(spark.createDataFrame(long, schema), root, "t", 1, span=(long[0][0], long[-1][0]))
    assert len([d for d, _, _ in os.walk(tmp_path) if os.path.basename(d).startswith("batch=")]) <= 2 + store.MOST
    assert store.whole(spark, root, "t", schema).count() == 3002
    got = store.recent(spark, root, "t", schema, 0.0, 2 * hour, 9)
    assert sorted((r.ts, r.v, r.batch) for r in got.collect()) == [(5.0, 0, 0), (7.0, 0, 1), (hour + 5.0, 1, 0), (hour + 7.0, 1, 1)]
    got = store.recent(spark, root, "t", schema, 1000 * hour, 1001 * hour, 9)
    assert [r.v for r in got.collect()] == [1000] and len(got.inputFiles()) <= 4
    assert [store.recent(spark, root, "t", schema, 0.0, 1e9, n).count() for n in (0, 1, 2)] == [0, 2, 3002]
    store.purge(spark, root, "t", 300 * hour)  # the folder of hours 256 to 511 is still needed
    assert store.whole(spark, root, "t", schema).agg(F.min("v"), F.count("*")).first() == (256, 2744)


def test_cooldown_followed_over_long_batches(spark, tmp_path):
    """Two batches over hundreds of hours fire what one pass over all rows fires, in few folders and with the session as it was."""
    rows = spark.createDataFrame([(i, 400.0 * i, f"k{i % 3}" if i % 7 else None) for i in range(3000)], "id bigint, ts double, k string")
    want = sorted(tuple(r) for r in cooldown(rows, ["k"], 3000.0, seq="id").collect())
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in a stream with state
    try:
        parts = [held.follow_cooldown(rows.filter(part), ["k"], 3000.0, str(tmp_path), n, seq="id")
                 for n, part in enumerate(("id < 1501", "id >= 1501"))]
        assert spark.conf.get("spark.sql.adaptive.enabled") == "false"
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(tuple(r) for p in parts for r in p.collect()) == want
    assert len([d for d, _, _ in os.walk(tmp_path) if os.path.basename(d).startswith("batch=")]) <= 2 * store.MOST


def test_tail_follows_growth_and_rotation(spark, tmp_path):
    """Whole lines only, each once; a renamed file is read on, a new one under the old name from its start."""
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    line = "{} Failed password for u{} from 10.0.0.{} port 22\n"

    def run():
        stream = authlog.stream(spark, f"file://{logs}/auth.log*", F.substring_index("line", " ", 1).cast("double"))
        (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state"))
         .trigger(availableNow=True).start().awaitTermination())
        return sorted(r.ts for r in spark.read.parquet(out).collect())

    (logs / "auth.log").write_text(line.format(1, 1, 1) + line.format(2, 2, 2) + "3 Failed password for u3 fr")
    assert run() == [1, 2]
    with (logs / "auth.log").open("a") as f:
        f.write("om 10.0.0.3 port 22\n" + line.format(4, 4, 4))
    assert run() == [1, 2, 3, 4]
    with (logs / "auth.log").open("a") as f:
        f.write(line.format(5, 5, 5))
    (logs / "auth.log").rename(logs / "auth.log.1")
    (logs / "auth.log").write_text(line.format(6, 6, 6))
    assert run() == [1, 2, 3, 4, 5, 6]
    assert run() == [1, 2, 3, 4, 5, 6]


def test_tail_parts_hold_each_line_once(spark, tmp_path):
    from packetloom.sources.tail import LogTailReader

    lines = [f"{i} " + "x" * (i * 37 % 90) for i in range(300)]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\nunfinished")
    for size in (1, 10, 77, 1000, 1 << 20):
        reader = LogTailReader({"path": f"file://{tmp_path}/*.log", "partBytes": str(size)})
        parts = reader.partitions({}, reader.latestOffset())
        got = [x for p in parts for batch in reader.read(p) for x in batch.column("line").to_pylist()]
        assert got == lines
