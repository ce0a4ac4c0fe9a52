"""Service inventory → product, outdated versions, known vulnerabilities, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import lookup
from ..functions.net import _let
from ..functions.severity import CVSS_SCALE, cvss_severity
from ..functions.versions import (
    cpe, identify_product, is_outdated, latest_version, parse_constraints, satisfies_parsed, version_key,
)

# Service usually found on a port.
PORT_SERVICES = {
    21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "dns", 69: "tftp", 80: "http", 110: "pop3",
    111: "rpcbind", 135: "msrpc", 139: "netbios-ssn", 143: "imap", 161: "snmp", 389: "ldap",
    443: "https", 445: "microsoft-ds", 465: "smtps", 514: "syslog", 587: "submission", 631: "ipp",
    636: "ldaps", 993: "imaps", 995: "pop3s", 1080: "socks", 1433: "ms-sql", 1521: "oracle",
    1723: "pptp", 2049: "nfs", 2375: "docker", 3306: "mysql", 3389: "rdp", 5060: "sip",
    5432: "postgresql", 5900: "vnc", 5985: "winrm", 6379: "redis", 6667: "irc", 8000: "http-alt",
    8080: "http-proxy", 8443: "https-alt", 8888: "http-alt", 9200: "elasticsearch",
    11211: "memcached", 27017: "mongodb",
}


def port_service(port: Column) -> Column:
    return lookup(port, PORT_SERVICES)


def service_label(product: Column, version: Column, service: Column) -> Column:
    given = F.coalesce(product, F.lit("")) != ""
    return (
        F.when(given & (F.coalesce(version, F.lit("")) != ""), F.concat_ws(" ", product, version))
        .when(given, product)
        .when(F.coalesce(service, F.lit("")) != "", service)
        .otherwise(F.lit("unknown"))
    )


def enrich(services: DataFrame, specific_first: bool = False) -> DataFrame:
    """Add service, product, version, latest version, outdated, CPE and label from port and banner."""
    found = services.withColumn("__p", identify_product(F.col("banner"), specific_first))
    named = found.select(
        *services.columns,
        F.coalesce("__p.service", port_service(F.col("port"))).alias("service"),
        F.col("__p.product").alias("product"), F.col("__p.version").alias("version"),
        latest_version(F.col("__p.product")).alias("latest_version"),
    )
    return (
        named.withColumn("outdated", is_outdated(F.col("version"), F.col("latest_version")))
        .withColumn("cpe", cpe(F.col("product"), F.col("version")))
        .withColumn("label", service_label(F.col("product"), F.col("version"), F.col("service")))
    )


def by_product(cves: DataFrame) -> DataFrame:
    """One row per product with its records, highest score first and constraints parsed once."""
    record = F.struct(
        (-F.col("cvss")).alias("order"), F.col("position"), F.col("cve_id"), F.col("severity"), F.col("cvss"),
        F.col("summary"), F.col("affected"), F.col("fixed_version"), F.col("references"),
        parse_constraints(F.col("affected")).alias("constraints"),
    )
    return cves.groupBy("product").agg(F.array_sort(F.collect_list(record)).alias("records"))


def match(services: DataFrame, cves: DataFrame) -> DataFrame:
    """Add ``vulnerabilities``: matching records per service row, best score first, each id once.

    Many services share a product and version, so the record list of a product meets each distinct pair
    once, and the short result is joined back to the services.
    """
    pairs = services.filter(F.col("product").isNotNull()).select(F.col("product").alias("__product"), F.col("version").alias("version")).distinct()
    # Arrays of (key, constraint) are compared per record, with the version key made once per pair.
    keyed = pairs.withColumn("__key", version_key(F.col("version")))
    records = by_product(cves).withColumnRenamed("product", "__name")
    joined = keyed.join(records, F.lower("__product") == F.col("__name"))

    def affected(r: Column) -> Column:
        return F.col("version").isNull() | (F.coalesce(r["affected"], F.lit("")) == "") | satisfies_parsed(
            F.col("version"), F.col("__key"), r["affected"], r["constraints"])

    def public(r: Column) -> Column:
        return F.struct(
            r["cve_id"].alias("cve_id"), r["severity"].alias("severity"), r["cvss"].alias("cvss"),
            r["summary"].alias("summary"), r["affected"].alias("affected"), r["fixed_version"].alias("fixed_version"),
            r["references"].alias("references"),
        )

    def firsts(hits: Column) -> Column:
        # The first record of an id is the one with the highest score.
        return _let(F.transform(hits, lambda r: r["cve_id"]), lambda ids: F.transform(
            F.filter(hits, lambda r, i: F.array_position(ids, r["cve_id"]) == i + 1), public))

    found_records = _let(F.filter("records", affected), firsts)
    found = joined.select("__product", F.col("version").alias("__version"), found_records.alias("vulnerabilities"))
    none = F.array().cast(found.schema["vulnerabilities"].dataType)
    back = services.join(found, (F.col("product") == F.col("__product")) & F.col("version").eqNullSafe(F.col("__version")), "left")
    return back.withColumn("vulnerabilities", F.coalesce("vulnerabilities", none)).drop("__product", "__version")


def with_risk(matched: DataFrame) -> DataFrame:
    """Highest score and its severity per service row."""
    top = F.coalesce(F.array_max(F.transform("vulnerabilities", lambda v: v["cvss"])), F.lit(0.0))
    return matched.withColumn("max_cvss", top).withColumn("risk", cvss_severity(F.col("max_cvss")))


def findings(matched: DataFrame) -> DataFrame:
    """One row per service and vulnerability."""
    keep = [c for c in matched.columns if c != "vulnerabilities"]
    return matched.select(*keep, F.inline("vulnerabilities"))


def severity_counts(found: DataFrame) -> DataFrame:
    """Findings per severity, levels without findings included."""
    spark = found.sparkSession
    levels = spark.createDataFrame([(name,) for name in CVSS_SCALE], "severity string")
    counted = found.groupBy("severity").agg(F.count("*").alias("n"))
    return levels.join(counted, "severity", "full").select("severity", F.coalesce("n", F.lit(0)).alias("findings"))


def host_risk(matched: DataFrame) -> DataFrame:
    """Highest score per host and its severity."""
    scored = with_risk(matched).groupBy("host").agg(
        F.max("max_cvss").alias("max_cvss"), F.count("*").alias("services"),
        F.sum(F.size("vulnerabilities")).cast("long").alias("findings"))
    return scored.withColumn("risk", cvss_severity(F.col("max_cvss")))


def open_totals(hosts: DataFrame, services: DataFrame) -> DataFrame:
    """Hosts, hosts up, and open ports of a report."""
    up = hosts.agg(F.count("*").alias("hosts"), F.count_if("alive").alias("hosts_up"))
    opened = services.agg(F.count_if(F.col("state") == "open").alias("open_ports"))
    return up.withColumn("open_ports", opened.scalar())


def gate(found: DataFrame, minimum: str) -> DataFrame:
    """Is there a finding of at least the given severity (and above none)?"""
    level = lookup(F.col("severity"), CVSS_SCALE)
    return found.agg(
        F.coalesce(F.max(level) >= max(CVSS_SCALE[minimum], 1), F.lit(False)).alias("blocked"))


def one_per_port(services: DataFrame, seq: str = "service_id") -> DataFrame:
    """The newest row of each (host, port): a report holds one result per port."""
    rest = [c for c in services.columns if c not in ("host", "port")]
    picked = services.groupBy("host", "port").agg(F.max_by(F.struct(*rest), seq).alias("r"))
    return picked.select("host", "port", "r.*")


def nested_hosts(matched: DataFrame) -> DataFrame:
    """One row per host with its ports (ascending) and their vulnerabilities.

    Needs one row per (host, port), so a host holds at most 65,536 entries.
    """
    rows = with_risk(matched)
    port = F.struct(
        "port", F.lit("tcp").alias("protocol"), F.lit("open").alias("state"), "service", "product", "version",
        "banner", "latest_version", "outdated", "cpe", "risk", "vulnerabilities",
    )
    grouped = rows.groupBy("host").agg(
        F.max("max_cvss").alias("top"), F.sort_array(F.collect_list(port)).alias("ports"))
    return grouped.select(
        "host", F.lit(None).cast("string").alias("hostname"), F.lit(True).alias("alive"),
        cvss_severity(F.col("top")).alias("risk"), "ports")


def report_rows(matched: DataFrame) -> DataFrame:
    """Flat report rows: port, service, product text, note and vulnerability list, in full; cutting to a width is layout."""
    note = F.when(F.col("outdated"), F.concat(F.lit("outdated (latest "), "latest_version", F.lit(")"))).otherwise(F.lit(""))
    return matched.select(
        "host", F.concat_ws("/", F.col("port").cast("string"), F.lit("tcp")).alias("port"),
        F.coalesce("service", F.lit("-")).alias("service"), F.col("label").alias("product"), note.alias("note"),
        F.transform("vulnerabilities", lambda v: F.concat(
            F.lit("["), F.upper(v["severity"]), F.lit("] "), v["cve_id"], F.lit(" (CVSS "), v["cvss"].cast("string"), F.lit(")"),
            F.coalesce(F.concat(F.lit(" fixed in "), v["fixed_version"]), F.lit("")))).alias("vulnerabilities"),
    )
