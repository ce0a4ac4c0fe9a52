"""Windowed detections over packets and login events, blocklist matching, alert suppression.

Findings are rows ``ts, kind, severity, src_ip, title, detail, score`` plus the numbers they
rest on.  Nothing reads the clock: ``as_of`` is the time of the detection cycle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import syn_only_text
from ..functions.net import ipv4_number, ipv4_prefix_key
from ..functions.severity import MONITOR_SCALE, monitor_rank
from .cooldown import cooldown
from .predicates import not_whitelisted
from .reputation import advance, fold

FINDING_COLUMNS = ["ts", "kind", "severity", "src_ip", "title", "detail", "score"]

# Reputation points per kind of finding.
POINTS = {"port_scan": 40, "brute_force": 50, "traffic_spike": 20, "threat_feed": 60}
# Addresses that are never reported.
DEFAULT_WHITELIST = ["127.0.0.1", "10.0.0.1"]


def latest(df: DataFrame, ts: str = "ts") -> Column:
    """The default ``as_of``: the newest row."""
    return df.agg(F.max(ts).alias("as_of")).scalar()


def _recent(df: DataFrame, window: float, as_of: Column | float | None) -> tuple[DataFrame, Column]:
    at = latest(df) if as_of is None else as_of if isinstance(as_of, Column) else F.lit(float(as_of))
    return df.filter(F.col("ts") >= at - F.lit(float(window))), at


def cycle_copies(df: DataFrame, window: float, slide: float, keys: list[str], **counts: Column) -> DataFrame:
    """Counts of (keys) for every detection cycle that sees them, as (keys, cycle, at, counts).

    Cycles run every ``slide`` seconds on a fixed grid and look back ``window`` seconds, both
    ends included, so a row at t belongs to cycles in [t, t + window].  Rows that belong to the same
    cycles are added up first; only these sums are copied, one copy for each cycle.
    """
    first = F.ceil(F.col("ts") / slide).alias("__first")
    last = F.floor((F.col("ts") + F.lit(float(window))) / slide).alias("__last")
    summed = df.groupBy(*keys, first, last).agg(*[c.alias(name) for name, c in counts.items()])
    return summed.select(*keys, F.explode(F.sequence("__first", "__last")).alias("cycle"), *counts).withColumn(
        "at", F.col("cycle") * F.lit(float(slide)))


def _per_source(rows: DataFrame, by: list[str]) -> DataFrame:
    """Distinct ports first by (source, port): a busy source is spread over its ports."""
    return rows.groupBy(*by).agg(
        F.count_distinct("dst_port").alias("ports"), F.count("*").alias("packets"),
        F.count_if(syn_only_text(F.col("flags"))).alias("syns"),
    )


def _scan_findings(counted: DataFrame, at: Column, threshold: int, window: float, whitelist) -> DataFrame:
    hits = not_whitelisted(counted.filter(F.col("ports") >= threshold), whitelist)
    return hits.select(
        at.alias("ts"), F.lit("port_scan").alias("kind"),
        F.when(F.col("ports") >= threshold * 3, F.lit("high")).otherwise(F.lit("medium")).alias("severity"),
        "src_ip", F.concat(F.lit("Port scan detected from "), F.col("src_ip")).alias("title"),
        F.format_string(f"%d distinct ports, %d packets, %d SYN-only in {int(window)}s", "ports", "packets", "syns").alias("detail"),
        F.lit(POINTS["port_scan"]).alias("score"), "ports", "packets", "syns",
    )


def port_scans(packets: DataFrame, as_of=None, window: float = 60, distinct_ports: int = 15,
               whitelist=DEFAULT_WHITELIST) -> DataFrame:
    """Sources with many distinct destination ports in the window that ends at ``as_of``."""
    rows, at = _recent(packets.filter(F.col("dst_port").isNotNull()), window, as_of)
    return _scan_findings(_per_source(rows, ["src_ip"]), at, distinct_ports, window, whitelist)


def port_scan_cycles(packets: DataFrame, window: float = 60, slide: float = 15, distinct_ports: int = 15,
                     whitelist=DEFAULT_WHITELIST) -> DataFrame:
    """The same at every detection cycle of a recorded period."""
    rows = cycle_copies(packets.filter(F.col("dst_port").isNotNull()), window, slide, ["src_ip", "dst_port"],
                        packets=F.count("*"), syns=F.count_if(syn_only_text(F.col("flags"))))
    counted = rows.groupBy("src_ip", "at").agg(
        F.count_distinct("dst_port").alias("ports"), F.sum("packets").alias("packets"), F.sum("syns").alias("syns"))
    return _scan_findings(counted, F.col("at"), distinct_ports, window, whitelist)


def _brute_findings(counted: DataFrame, at: Column, threshold: int, window: float, whitelist) -> DataFrame:
    hits = not_whitelisted(counted.filter(F.col("failures") >= threshold), whitelist)
    return hits.select(
        at.alias("ts"), F.lit("brute_force").alias("kind"),
        F.when(F.col("failures") >= threshold * 4, F.lit("critical")).otherwise(F.lit("high")).alias("severity"),
        "src_ip", F.concat(F.lit("Brute force attempt from "), F.col("src_ip")).alias("title"),
        F.format_string(f"%d failed logins against %d usernames on %s in {int(window)}s", "failures", "users",
                        F.coalesce("service", F.lit("unknown"))).alias("detail"),
        F.lit(POINTS["brute_force"]).alias("score"), "failures", "users",
    )


def brute_force(auth_events: DataFrame, as_of=None, window: float = 300, failed_logins: int = 8,
                whitelist=DEFAULT_WHITELIST) -> DataFrame:
    """Sources with many failed logins in the window that ends at ``as_of``."""
    rows, at = _recent(auth_events, window, as_of)
    counted = rows.filter(~F.col("success")).groupBy("src_ip").agg(
        F.count("*").alias("failures"), F.count_distinct("username").alias("users"), F.max("service").alias("service"))
    return _brute_findings(counted, at, failed_logins, window, whitelist)


def brute_force_cycles(auth_events: DataFrame, window: float = 300, slide: float = 15, failed_logins: int = 8,
                       whitelist=DEFAULT_WHITELIST) -> DataFrame:
    rows = cycle_copies(auth_events.filter(~F.col("success")), window, slide, ["src_ip", "username"],
                        failures=F.count("*"), service=F.max("service"))
    counted = rows.groupBy("src_ip", "at").agg(
        F.sum("failures").alias("failures"), F.count_distinct("username").alias("users"), F.max("service").alias("service"))
    return _brute_findings(counted, F.col("at"), failed_logins, window, whitelist)


def traffic_windows(packets: DataFrame, window: float = 60) -> DataFrame:
    """Tumbling windows with packets, bytes and distinct sources (windows without packets have no row)."""
    return (
        packets.groupBy(F.floor(F.col("ts") / float(window)).alias("w"))
        .agg(F.count("*").alias("packet_count"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("byte_count"),
             F.count_distinct("src_ip").alias("unique_sources"))
        .select((F.col("w") * F.lit(float(window))).alias("window_start"),
                ((F.col("w") + 1) * F.lit(float(window))).alias("window_end"),
                "packet_count", "byte_count", "unique_sources")
    )


def traffic_totals(packets: DataFrame, as_of=None, window: float = 60) -> DataFrame:
    """Packets, bytes and distinct sources of the window that ends at ``as_of``."""
    rows, _ = _recent(packets, window, as_of)
    return rows.agg(F.count("*").alias("packets"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"),
                    F.count_distinct("src_ip").alias("sources"))


def traffic_spikes(packets: DataFrame, window: float = 60, history: int = 10, multiplier: float = 3.0,
                   min_events: int = 50, gap: int = 2, origin: float = 0.0) -> DataFrame:
    """Windows far above the mean of earlier ones, with their busiest source.

    The baseline of window w is the ``history`` windows that end strictly before w starts
    (``gap`` = 2 on a touching grid), empty windows included, at least three of them.  Each
    window is sent to the windows it is a baseline of, so no global sort is needed and empty
    windows enter as arithmetic: they add to the count and not to the sums.
    """
    start = F.lit(float(origin))
    # a closed window ends at the origin's grid: a row on the edge belongs to the window that ends there
    place = F.ceil((F.col("ts") - start) / float(window)) - 1 if origin else F.floor((F.col("ts") - start) / float(window))
    per_source = packets.groupBy(place.alias("w"), "src_ip").agg(F.count("*").alias("n"))
    first = packets.agg(F.min(place).alias("first")).scalar()
    judged = _judge_spikes(per_source, first, gap, history, multiplier, min_events)
    return _spike_findings(judged, (F.col("at") + 1) * F.lit(float(window)) + start, window)


def spike_cycles(packets: DataFrame, window: float = 60, slide: float = 15, history: int = 10, multiplier: float = 3.0,
                 min_events: int = 50, first_cycle: Column | int | None = None) -> DataFrame:
    """The same at every detection cycle: the window that ends there against the latest ``history`` windows of
    earlier cycles that end before it starts, cycles without packets included, from the monitor's first cycle on."""
    per_source = cycle_copies(packets, window, slide, ["src_ip"], n=F.count("*")).groupBy(F.col("cycle").alias("w"), "src_ip").agg(F.sum("n").alias("n"))
    if first_cycle is None:
        first_cycle = packets.agg(F.min(F.ceil(F.col("ts") / slide)).alias("first")).scalar()
    gap = int(window // slide) + 1
    judged = _judge_spikes(per_source, first_cycle if isinstance(first_cycle, Column) else F.lit(first_cycle), gap, history, multiplier, min_events)
    return _spike_findings(judged, F.col("at") * F.lit(float(slide)), window)


def _judge_spikes(per_source: DataFrame, first: Column, gap: int, history: int, multiplier: float, min_events: int) -> DataFrame:
    """Windows ``w`` far above the ``history`` windows from w - gap backwards, none before ``first``."""
    per_window = per_source.groupBy("w").agg(
        F.sum("n").alias("packets"),
        F.max(F.struct(F.col("n").alias("n"), F.col("src_ip").alias("src_ip"))).alias("top"),
    )
    role = F.array(
        F.struct(F.col("w").alias("at"), F.col("packets").alias("current"), F.col("top.src_ip").alias("talker"),
                 F.lit(None).cast("long").alias("before")),
    )
    sent = F.transform(
        F.sequence(F.col("w") + gap, F.col("w") + gap + history - 1),
        lambda at: F.struct(at.alias("at"), F.lit(None).cast("long").alias("current"),
                            F.lit(None).cast("string").alias("talker"), F.col("packets").alias("before")),
    )
    merged = (
        per_window.select(F.inline(F.concat(role, sent)))
        .groupBy("at")
        .agg(F.max("current").alias("packets"), F.max("talker").alias("src_ip"),
             F.coalesce(F.sum("before"), F.lit(0)).cast("double").alias("total"),
             F.coalesce(F.sum(F.col("before") * F.col("before")), F.lit(0)).cast("double").alias("squares"))
        .withColumn("windows", F.least(F.lit(history), F.col("at") - gap - first + 1))
        .filter((F.col("packets") >= min_events) & (F.col("windows") >= 3))
    )
    n = F.col("windows")
    variance = F.greatest((n * F.col("squares") - F.col("total") * F.col("total")) / (n * n), F.lit(0.0))
    deviation = F.when(variance == 0, F.lit(1.0)).otherwise(F.sqrt(variance))
    judged = merged.withColumn("mean", F.col("total") / n).withColumn(
        "threshold", F.col("mean") + F.lit(float(multiplier)) * deviation)
    return judged.filter(F.col("packets") > F.col("threshold"))


def _spike_findings(judged: DataFrame, ts: Column, window: float) -> DataFrame:
    return judged.select(
        ts.alias("ts"), F.lit("traffic_spike").alias("kind"),
        F.lit("medium").alias("severity"), "src_ip", F.lit("Unusual traffic spike detected").alias("title"),
        F.format_string(
            f"%d packets in {int(window)}s vs baseline mean %.1f (threshold %.1f), top talker %s",
            "packets", "mean", "threshold", F.coalesce("src_ip", F.lit("n/a"))).alias("detail"),
        F.col("packets").cast("int").alias("score"), "packets", "mean", "threshold",
    )


def top_talker(packets: DataFrame, as_of=None, window: float = 60) -> DataFrame:
    """Busiest source of the window."""
    rows, _ = _recent(packets, window, as_of)
    return rows.groupBy("src_ip").agg(F.count("*").alias("packets")).orderBy(F.desc("packets"), "src_ip").limit(1)


def active_sources(packets: DataFrame, auth_events: DataFrame, as_of=None, window: float = 900) -> DataFrame:
    """Distinct sources of packets and login events; each side is made distinct before the union."""
    if as_of is None:
        ends = packets.agg(F.max("ts").alias("t")).union(auth_events.agg(F.max("ts").alias("t")))
        as_of = ends.agg(F.max("t")).scalar()
    parts = [_recent(df, window, as_of)[0].select("src_ip").distinct() for df in (packets, auth_events)]
    return parts[0].union(parts[1]).distinct()


def blocklisted(sources: DataFrame, blocklist: DataFrame, ip: str = "src_ip") -> DataFrame:
    """Sources on the blocklist (exact text).  Spark broadcasts the list only if its size allows."""
    return sources.join(blocklist.select(F.col("ip").alias(ip)), ip, "left_semi")


def blocklisted_networks(sources: DataFrame, networks: DataFrame, ip: str = "src_ip") -> DataFrame:
    """Sources inside listed networks (``a.b.c.d/n``), as an equality join.

    Each source is looked up once per prefix length that occurs in the list (33 at most).
    """
    parsed = networks.select(
        "network", "source",
        ipv4_number(F.substring_index("network", "/", 1)).alias("number"),
        F.coalesce(F.try_element_at(F.split("network", "/"), F.lit(2)).cast("int"), F.lit(32)).alias("length"),
    ).select("network", "source", "length", ipv4_prefix_key(F.col("number"), F.col("length")).alias("prefix"))
    lengths = parsed.agg(F.sort_array(F.collect_set("length"))).scalar()
    probes = (
        sources.withColumn("__number", ipv4_number(F.col(ip)))
        .filter(F.col("__number").isNotNull())
        .withColumn("length", F.explode(lengths))
        .withColumn("prefix", ipv4_prefix_key(F.col("__number"), F.col("length")))
    )
    return probes.join(parsed, ["length", "prefix"]).drop("__number", "prefix")


def suspicious_ips(reputation: DataFrame, as_of: Column | float, threshold: int = 50, window: float = 900,
                   whitelist=DEFAULT_WHITELIST) -> DataFrame:
    """Addresses with a high score that were seen recently."""
    at = as_of if isinstance(as_of, Column) else F.lit(float(as_of))
    rows = reputation.filter((F.col("score") >= threshold) & (F.col("last_seen") >= at - F.lit(float(window))))
    return not_whitelisted(rows, whitelist, ip="ip").select(
        at.alias("ts"), F.lit("suspicious_ip").alias("kind"),
        F.when(F.col("score") >= 80, F.lit("critical")).otherwise(F.lit("high")).alias("severity"),
        F.col("ip").alias("src_ip"),
        F.format_string("Suspicious IP %s (score %d)", "ip", "score").alias("title"),
        F.format_string("blocklisted=%s reasons=%s", F.initcap(F.col("blocklisted").cast("string")),
                        F.when(F.col("notes") != "", F.col("notes")).otherwise(F.lit("behavioral"))).alias("detail"),
        F.col("score").cast("int").alias("score"),
    )


def suppress(findings: DataFrame, seconds: float = 300, minimum: str = "medium", seq: str = "id") -> DataFrame:
    """Drop low severities, then repeats of a (kind, source) within the cooldown.

    Dropped findings do not restart the clock; a missing source is a key of its own.
    """
    kept = findings.filter(monitor_rank(F.col("severity")) >= MONITOR_SCALE[minimum])
    return cooldown(kept, ["kind", "src_ip"], seconds, seq=seq)


def last_alert(alerts: DataFrame) -> DataFrame:
    """Newest alert time per (kind, source), a missing source included."""
    return alerts.groupBy("kind", "src_ip").agg(F.max("ts").alias("last_ts"))


def not_in_cooldown(findings: DataFrame, alerts: DataFrame, seconds: float = 300) -> DataFrame:
    """Findings of one cycle whose last stored alert is old enough (null-safe lookup); reads the alerts of the cooldown only."""
    since = findings.agg(F.min("ts") - F.lit(float(seconds))).scalar()
    last = last_alert(alerts.filter(F.col("ts") > since)).select(F.col("kind").alias("__kind"), F.col("src_ip").alias("__src"), "last_ts")
    joined = findings.join(
        last, (F.col("kind") == F.col("__kind")) & F.col("src_ip").eqNullSafe(F.col("__src")), "left")
    return joined.filter(F.col("ts") - F.coalesce("last_ts", F.lit(0.0)) >= seconds).drop("__kind", "__src", "last_ts")


def score_cycles(packets: DataFrame, auth_events: DataFrame, scans: DataFrame, logins: DataFrame, spikes: DataFrame, blocklist: DataFrame,
                 slide: float = 15, activity: float = 900, whitelist=DEFAULT_WHITELIST) -> DataFrame:
    """Score events (ip, ts, seq, points, note, blocklisted) of every cycle: findings, and listed sources while active."""
    def scored(rows: DataFrame, seq: int, note: str, flag: bool | None = None) -> DataFrame:
        return rows.select(F.col("src_ip").alias("ip"), "ts", F.lit(seq).alias("seq"), F.lit(POINTS[note]).alias("points"),
                           F.lit(note).alias("note"), F.lit(flag).cast("boolean").alias("blocklisted"))

    seen = packets.select("src_ip", "ts").unionByName(auth_events.select("src_ip", "ts"))
    listed = not_whitelisted(blocklisted(seen, blocklist), whitelist)
    active = cycle_copies(listed, activity, slide, ["src_ip"], n=F.count("*")).groupBy("src_ip", "at").agg(F.count("*").alias("n"))
    return (scored(scans, 0, "port_scan").unionByName(scored(logins, 1, "brute_force"))
            .unionByName(scored(not_whitelisted(spikes, whitelist), 2, "traffic_spike"))
            .unionByName(scored(active.withColumnRenamed("at", "ts"), 3, "threat_feed", True)))


def detection_cycles(
    packets: DataFrame, auth_events: DataFrame, blocklist: DataFrame, low: int, high: int, first_cycle: int | None = None,
    reputation: DataFrame | None = None, slide: float = 15, activity: float = 900, threshold: int = 50, whitelist=DEFAULT_WHITELIST,
    **spike,
) -> tuple[DataFrame, DataFrame]:
    """Findings of the cycles ``low``..``high`` (numbers of ``slide`` seconds) in one plan, and the reputation after them.

    Rows from ``activity`` seconds before the first cycle on are needed.  ``reputation`` is the state before it; score
    events of a source are folded in order, and a source whose score reaches the threshold is suspicious at
    every cycle from the event on until the next event or until it was not seen for ``activity`` seconds.
    """
    inside = lambda df: df.filter(F.col("ts").between(low * float(slide), high * float(slide)))
    scans = inside(port_scan_cycles(packets, slide=slide, whitelist=whitelist))
    logins = inside(brute_force_cycles(auth_events, slide=slide, whitelist=whitelist))
    spikes = inside(spike_cycles(packets, slide=slide, first_cycle=first_cycle, **spike))
    events = inside(score_cycles(packets, auth_events, scans, logins, spikes, blocklist, slide, activity, whitelist))
    states, after = advance(events, reputation, cycle_seconds=slide)
    until = F.least(F.floor((F.col("ts") + F.lit(float(activity))) / slide), F.coalesce(F.ceil(F.col("next_ts") / slide) - 1, F.lit(high)), F.lit(high))
    shown = (states.filter(F.col("score") >= threshold).withColumn("low", F.greatest(F.ceil(F.col("ts") / slide), F.lit(low))).withColumn("until", until)
             .filter("low <= until").withColumn("cycle", F.explode(F.sequence("low", "until"))).withColumn("at", F.col("cycle") * F.lit(float(slide))))
    suspects = suspicious_ips(shown.withColumn("last_seen", F.col("ts")), F.col("at"), threshold, activity, whitelist)
    findings = None
    for part in (scans, logins, spikes, suspects):
        part = part.select(*FINDING_COLUMNS)
        findings = part if findings is None else findings.unionByName(part)
    return findings, after


def detection_cycle(
    packets: DataFrame, auth_events: DataFrame, blocklist: DataFrame, score_events: DataFrame, as_of: float,
    whitelist=DEFAULT_WHITELIST,
) -> tuple[DataFrame, DataFrame]:
    """One cycle: scans, brute force, spikes, then suspicious addresses with the scores just given.

    Returns the findings (before suppression) and the score events, earlier and new.
    """
    scans = port_scans(packets, as_of, whitelist=whitelist)
    logins = brute_force(auth_events, as_of, whitelist=whitelist)
    spikes = traffic_spikes(packets, origin=as_of).filter(F.col("ts") == as_of)
    active = not_whitelisted(active_sources(packets, auth_events, as_of), whitelist)
    listed = blocklisted(active, blocklist)

    def scored(rows: DataFrame, seq: int, note: str, flag: bool | None = None) -> DataFrame:
        return rows.select(
            F.col("src_ip").alias("ip"), F.lit(float(as_of)).alias("ts"), F.lit(seq).alias("seq"),
            F.lit(POINTS[note]).alias("points"), F.lit(note).alias("note"),
            F.lit(flag).cast("boolean").alias("blocklisted"),
        )

    if "blocklisted" not in score_events.columns:
        score_events = score_events.withColumn("blocklisted", F.lit(None).cast("boolean"))
    events = (
        score_events.unionByName(scored(scans, 0, "port_scan"))
        .unionByName(scored(logins, 1, "brute_force"))
        .unionByName(scored(not_whitelisted(spikes, whitelist), 2, "traffic_spike"))
        .unionByName(scored(listed, 3, "threat_feed", True))
    )
    suspects = suspicious_ips(fold(events, as_of - 1e-3), as_of, whitelist=whitelist)
    frames = [f.select(*FINDING_COLUMNS) for f in (scans, logins, spikes, suspects)]
    findings = frames[0]
    for frame in frames[1:]:
        findings = findings.unionByName(frame)
    return findings, events
