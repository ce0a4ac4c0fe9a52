"""Queries over the service inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.severity import cvss_severity
from ..functions.versions import cpe, identify_product, satisfies
from ..sources import cves
from ..operators import targets
from ..operators import vulnerability as vuln
from .registry import query
from .views import view


def services(spark, sf_dir):
    return view(spark, sf_dir, "services")


def cve_rows(spark, sf_dir):
    rows = view(spark, sf_dir, "cves").withColumn("cvss", F.col("cvss").cast("double"))
    return rows.withColumns({
        "severity": cvss_severity(F.col("cvss")), "summary": F.lit(""),
        "references": F.array().cast("array<string>"),
    })


def matched(spark, sf_dir):
    return vuln.match(vuln.enrich(services(spark, sf_dir)), cve_rows(spark, sf_dir))


def _identified(generic_last: bool) -> str:
    generic = r"WHEN regexp_matches(banner, '[0-9]+\.[0-9]+\.[0-9]') THEN {'s': 'mysql', 'p': 'MySQL', 'v': regexp_extract(banner, '([0-9]+\.[0-9]+\.[0-9][0-9a-zA-Z._]*)', 1)}"
    later = r"""WHEN banner LIKE 'Samba %' THEN {'s': 'smb', 'p': 'Samba', 'v': regexp_extract(banner, 'Samba (.*)', 1)}
  WHEN banner LIKE '%Dovecot%' THEN {'s': 'pop3', 'p': 'Dovecot', 'v': NULL}
  WHEN banner LIKE 'redis_version:%' THEN {'s': 'redis', 'p': 'Redis', 'v': regexp_extract(banner, ':(.*)', 1)}"""
    tail = f"{later}\n  {generic}" if generic_last else f"{generic}\n  {later}"
    return rf"""
, ident AS (SELECT *, CASE
  WHEN contains(banner, 'OpenSSH') THEN {{'s': 'ssh', 'p': 'OpenSSH', 'v': regexp_extract(banner, 'OpenSSH_([0-9a-z._]+)', 1)}}
  WHEN contains(banner, 'Apache/') THEN {{'s': 'http', 'p': 'Apache httpd', 'v': regexp_extract(banner, 'Apache/([0-9.]+)', 1)}}
  WHEN contains(banner, 'nginx/') THEN {{'s': 'http', 'p': 'nginx', 'v': regexp_extract(banner, 'nginx/(.*)', 1)}}
  WHEN contains(banner, 'IIS/') THEN {{'s': 'http', 'p': 'Microsoft-IIS', 'v': regexp_extract(banner, 'IIS/(.*)', 1)}}
  WHEN contains(banner, 'vsFTPd') THEN {{'s': 'ftp', 'p': 'vsftpd', 'v': regexp_extract(banner, 'vsFTPd ([0-9.]+)', 1)}}
  WHEN contains(banner, 'ProFTPD') THEN {{'s': 'ftp', 'p': 'ProFTPD', 'v': regexp_extract(banner, 'ProFTPD ([0-9.]+)', 1)}}
  WHEN contains(banner, 'Exim') THEN {{'s': 'smtp', 'p': 'Exim', 'v': regexp_extract(banner, 'Exim (.*)', 1)}}
  {tail} END AS i FROM services),
enriched AS (SELECT service_id, host, port, banner, coalesce(i.s, CASE port WHEN 3389 THEN 'rdp' WHEN 22 THEN 'ssh' WHEN 21 THEN 'ftp' END) AS service,
  i.p AS product, i.v AS version FROM ident)"""


KEY = "list_transform(regexp_extract_all(lower({0}), '[0-9]+|[a-z]+'), lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN {{'k': 1, 'n': length(ltrim(t, '0')), 'w': ltrim(t, '0')}} ELSE {{'k': 0, 'n': 0::BIGINT, 'w': t}} END)"
LATEST = """CASE lower(product) WHEN 'openssh' THEN '9.8p1' WHEN 'apache httpd' THEN '2.4.62' WHEN 'nginx' THEN '1.27.1'
  WHEN 'microsoft-iis' THEN '10.0' WHEN 'vsftpd' THEN '3.0.5' WHEN 'proftpd' THEN '1.3.8' WHEN 'exim' THEN '4.98' WHEN 'mysql' THEN '8.4.2'
  WHEN 'samba' THEN '4.20.2' WHEN 'redis' THEN '7.4.0' END"""
SEVERITY = "CASE WHEN {0} >= 9 THEN 'critical' WHEN {0} >= 7 THEN 'high' WHEN {0} >= 4 THEN 'medium' WHEN {0} > 0 THEN 'low' ELSE 'none' END"


def _matched(generic_last: bool = False) -> str:
    return _identified(generic_last) + f""",
parts AS (SELECT cve_id, regexp_extract(part, '^([<>=!]*)', 1) AS op, regexp_extract(part, '^[<>=!]*(.*)$', 1) AS target
          FROM (SELECT cve_id, unnest(string_split(affected, ' ')) AS part FROM cves)),
versions AS (SELECT DISTINCT product, version FROM enriched WHERE product IS NOT NULL),
tested AS (SELECT v.product, v.version, c.cve_id, bool_and(v.version IS NULL OR CASE op
    WHEN '<' THEN {KEY.format('v.version')} < {KEY.format('target')} WHEN '<=' THEN {KEY.format('v.version')} <= {KEY.format('target')}
    WHEN '>=' THEN {KEY.format('v.version')} >= {KEY.format('target')} ELSE {KEY.format('v.version')} = {KEY.format('target')} END) AS ok
  FROM versions v JOIN cves c ON c.product = lower(v.product) JOIN parts p ON p.cve_id = c.cve_id GROUP BY 1, 2, 3),
found AS (SELECT e.service_id, e.host, e.port, e.product, e.version, t.cve_id, CAST(c.cvss AS DOUBLE) AS cvss,
    {SEVERITY.format('c.cvss')} AS severity, c.fixed_version
  FROM enriched e JOIN tested t ON t.ok AND t.product = e.product AND t.version IS NOT DISTINCT FROM e.version
  JOIN cves c ON c.cve_id = t.cve_id)"""


@query("product_identify", "services", sql=_identified(False) + """
SELECT service_id, product, version FROM enriched""")
def product_identify(spark, sf_dir):
    return services(spark, sf_dir).select("service_id", identify_product(F.col("banner")).alias("i")).select(
        "service_id", "i.product", "i.version")


@query("product_identify_specific", "services", sql=_identified(True) + """
SELECT product, version, count(*) AS services FROM enriched GROUP BY 1, 2""")
def product_identify_specific(spark, sf_dir):
    return vuln.enrich(services(spark, sf_dir), specific_first=True).groupBy("product", "version").agg(
        F.count("*").alias("services"))


@query("port_service", "services", sql=_identified(False) + """
SELECT service_id, port, service, CASE WHEN product IS NOT NULL AND version IS NOT NULL THEN product || ' ' || version
  WHEN product IS NOT NULL THEN product ELSE coalesce(service, 'unknown') END AS label FROM enriched""")
def port_service(spark, sf_dir):
    return vuln.enrich(services(spark, sf_dir)).select("service_id", "port", "service", "label")


@query("outdated", "services", sql=_identified(False) + f"""
SELECT service_id, product, version, {LATEST} AS latest_version,
  coalesce(version IS NOT NULL AND {KEY.format('version')} < {KEY.format('(' + LATEST + ')')}, false) AS outdated,
  'cpe:2.3:a:' || replace(replace(lower(product), ' ', '_'), '-', '_') || ':' || replace(replace(lower(product), ' ', '_'), '-', '_')
    || ':' || coalesce(version, '*') || ':*:*:*:*:*:*:*' AS cpe FROM enriched""")
def outdated(spark, sf_dir):
    return vuln.enrich(services(spark, sf_dir)).select(
        "service_id", "product", "version", "latest_version", "outdated", "cpe")


@query("version_constraints", "services", sql=_identified(False) + f"""
SELECT service_id, version, {KEY.format('version')} >= {KEY.format("'2.4.17'")} AND {KEY.format('version')} < {KEY.format("'2.4.39'")} AS in_range,
  {KEY.format('version')} <> {KEY.format("'1.4.0'")} AND {KEY.format('version')} > {KEY.format("'1.3'")} AS newer,
  {KEY.format('version')} = {KEY.format("'7.2p2'")} AS exactly FROM enriched WHERE version IS NOT NULL""")
def version_constraints(spark, sf_dir):
    """Range, list with a comma, and bare constraints over every version seen."""
    rows = vuln.enrich(services(spark, sf_dir)).filter("version IS NOT NULL")
    return rows.select(
        "service_id", "version", satisfies(F.col("version"), F.lit(">=2.4.17 <2.4.39")).alias("in_range"),
        satisfies(F.col("version"), F.lit("!=1.4.0,>1.3")).alias("newer"),
        satisfies(F.col("version"), F.lit("> 7.2p2")).alias("exactly"))


@query("cve_match", "services", "cves", sql=_matched() + """
SELECT service_id, host, port, product, version, cve_id, cvss, severity, fixed_version FROM found""")
def cve_match(spark, sf_dir):
    return vuln.findings(matched(spark, sf_dir)).select(
        "service_id", "host", "port", "product", "version", "cve_id", "cvss", "severity", "fixed_version")


@query("cve_top", "services", "cves", sql=_matched() + """
SELECT cvss, cve_id, count(*) AS services FROM found GROUP BY 1, 2 ORDER BY 1 DESC, 2 LIMIT 5""")
def cve_top(spark, sf_dir):
    found = vuln.findings(matched(spark, sf_dir))
    return found.groupBy("cvss", "cve_id").agg(F.count("*").alias("services")).orderBy(F.desc("cvss"), "cve_id").limit(5)


@query("severity_counts", "services", "cves", sql=_matched() + """
SELECT s.severity, count(found.cve_id) AS findings FROM (VALUES ('none'), ('low'), ('medium'), ('high'), ('critical')) AS s(severity)
LEFT JOIN found ON found.severity = s.severity GROUP BY 1""")
def severity_counts(spark, sf_dir):
    return vuln.severity_counts(vuln.findings(matched(spark, sf_dir)))


@query("host_risk", "services", "cves", sql=_matched() + f""",
scored AS (SELECT host, max(cvss) AS m, count(*) AS n FROM found GROUP BY host)
SELECT host, coalesce(max(m), 0.0) AS max_cvss, count(*) AS services, CAST(coalesce(max(n), 0) AS BIGINT) AS findings,
  {SEVERITY.format('coalesce(max(m), 0.0)')} AS risk FROM enriched LEFT JOIN scored USING (host) GROUP BY host""")
def host_risk(spark, sf_dir):
    return vuln.host_risk(matched(spark, sf_dir))


@query("open_totals", "services", sql="""
SELECT count(DISTINCT host) AS hosts, count(DISTINCT host) FILTER (port <> 64999) AS hosts_up,
  (SELECT count(*) FROM services WHERE banner IS NOT NULL) AS open_ports FROM services""")
def open_totals(spark, sf_dir):
    rows = services(spark, sf_dir)
    hosts = rows.groupBy("host").agg(F.bool_or(F.col("port") != 64999).alias("alive"))
    ports = rows.withColumn("state", F.when(F.col("banner").isNotNull(), F.lit("open")).otherwise(F.lit("closed")))
    return vuln.open_totals(hosts, ports)


@query("gate", "services", "cves", sql=_matched() + """
SELECT bool_or(severity = 'critical') AS blocked FROM found""")
def gate(spark, sf_dir):
    return vuln.gate(vuln.findings(matched(spark, sf_dir)), "critical")


@query("host_report", "services", "cves", sql=_matched() + f""",
latest AS (SELECT host, port, max(service_id) AS service_id FROM enriched GROUP BY host, port),
ids AS (SELECT l.host, l.port, string_agg(f.cve_id, ',' ORDER BY f.cvss DESC, c.position) AS ids, max(f.cvss) AS m FROM latest l
  LEFT JOIN found f ON f.service_id = l.service_id LEFT JOIN cves c ON c.cve_id = f.cve_id GROUP BY 1, 2)
SELECT host, {SEVERITY.format('max(coalesce(m, 0))')} AS risk, CAST(count(*) AS INT) AS open_ports,
  string_agg(port || '=' || coalesce(ids, ''), ' ' ORDER BY port) AS ports FROM ids GROUP BY host""")
def host_report(spark, sf_dir):
    """The nested report per host, shown as one line of text per host."""
    rows = vuln.match(vuln.enrich(vuln.one_per_port(services(spark, sf_dir))), cve_rows(spark, sf_dir))
    nested = vuln.nested_hosts(rows)
    line = F.transform("ports", lambda p: F.concat_ws(
        "=", p["port"].cast("string"), F.array_join(F.transform(p["vulnerabilities"], lambda v: v["cve_id"]), ",")))
    return nested.select("host", "risk", F.size("ports").alias("open_ports"), F.array_join(line, " ").alias("ports"))


@query("report_rows", "services", "cves", sql=_matched() + f"""
SELECT host, port || '/tcp' AS port, coalesce(service, '-') AS service,
  CASE WHEN product IS NOT NULL AND version IS NOT NULL THEN product || ' ' || version WHEN product IS NOT NULL THEN product ELSE coalesce(service, 'unknown') END AS product,
  CASE WHEN coalesce(version IS NOT NULL AND {KEY.format('version')} < {KEY.format('(' + LATEST + ')')}, false) THEN 'outdated (latest ' || {LATEST} || ')' ELSE '' END AS note,
  coalesce((SELECT string_agg(t, ' ' ORDER BY t) FROM (SELECT '[' || upper(f.severity) || '] ' || f.cve_id || ' (CVSS ' || CAST(CAST(f.cvss AS DOUBLE) AS VARCHAR) || ')'
    || coalesce(' fixed in ' || f.fixed_version, '') AS t FROM found f WHERE f.service_id = enriched.service_id)), '') AS vulnerabilities FROM enriched""")
def report_rows(spark, sf_dir):
    return vuln.report_rows(matched(spark, sf_dir)).withColumn("vulnerabilities", F.array_join(F.array_sort("vulnerabilities"), " "))


@query("cpe_names", "services", sql=_identified(False) + """
SELECT 'cpe:2.3:a:' || translate(lower(product), ' -', '__') || ':' || translate(lower(product), ' -', '__') || ':*:*:*:*:*:*:*:*' AS cpe,
  count(*) AS services FROM enriched WHERE product IS NOT NULL GROUP BY 1""")
def cpe_names(spark, sf_dir):
    rows = vuln.enrich(services(spark, sf_dir)).filter("product IS NOT NULL")
    return rows.groupBy(cpe(F.col("product"), F.lit(None).cast("string")).alias("cpe")).agg(F.count("*").alias("services"))


def _specs(spark, sf_dir):
    """Specifications made from the inventory: networks of both families, ranges (one form reversed), names and broken ones."""
    rows = services(spark, sf_dir).select(
        F.col("service_id").alias("spec_id"), F.split("host", r"\.")[2].alias("c"), F.split("host", r"\.")[3].cast("int").alias("d"))
    c, d, k = F.col("c"), F.col("d"), F.col("spec_id") % 7
    own = F.concat(F.lit("10.1."), c, F.lit("."), d.cast("string"))
    upper = F.concat(F.lit("10.1."), c, F.lit("."), (d + 3).cast("string"))
    spec = (
        F.when(k == 0, F.concat(F.lit("192.168."), c, F.lit("."), d.cast("string"), F.lit("/30")))
        .when(k == 1, F.concat(own, F.lit("-"), (d + 3).cast("string")))
        .when(k == 2, F.concat(upper, F.lit("-"), own))
        .when(k == 3, F.concat(F.lit("host-"), d.cast("string")))
        .when(k == 4, F.concat(F.lit("fd00:"), c, F.lit(":"), F.lower(F.hex(d)), F.lit("::7/"), (F.lit(44) + d % 9).cast("string")))
        .when(k == 5, F.concat(F.lit("10.0.0.0/99 "), own, F.lit("-300")))
        .otherwise(own))
    return rows.select("spec_id", spec.alias("spec"))


SPECS = """
, specs AS (SELECT service_id, service_id % 7 AS k, split_part(host, '.', 3) AS c, CAST(split_part(host, '.', 4) AS INT) AS d FROM services)"""


@query("expand_targets", "services", sql=SPECS + """
SELECT DISTINCT target FROM (
  SELECT '192.168.' || c || '.' || (d // 4 * 4 + u) AS target FROM specs, (SELECT unnest([1, 2]) AS u) WHERE k = 0
  UNION ALL SELECT '10.1.' || c || '.' || unnest(range(d, d + 4)) FROM specs WHERE k IN (1, 2)
  UNION ALL SELECT '10.1.' || c || '.' || d FROM specs WHERE k = 6
  UNION ALL SELECT 'host-' || d FROM specs WHERE k = 3)""")
def expand_targets(spark, sf_dir):
    return targets.expand(_specs(spark, sf_dir)).select("target")


@query("target_ranges", "services", sql=SPECS + """
, v4 AS (SELECT service_id, k, c::BIGINT AS c, d::BIGINT AS d, (CASE WHEN k = 0 THEN 192 * 256 + 168 ELSE 10 * 256 + 1 END)::BIGINT * 65536 + c::BIGINT * 256
    + CASE WHEN k = 0 THEN d // 4 * 4 ELSE d END AS low FROM specs WHERE k IN (0, 1, 2, 6)),
v6 AS (SELECT service_id, c, d, 44 + d % 9 AS bits, lpad('fd00', 4, '0') || lpad(c, 4, '0') || lpad(printf('%x', d), 4, '0') AS groups FROM specs WHERE k = 4),
cut AS (SELECT service_id, bits, groups || '00000' AS digits, (bits // 4)::INT AS whole, (bits % 4)::INT AS rest FROM v6),
edges AS (SELECT service_id, substr(digits, 1, whole) AS head, rest, CAST('0x' || substr(digits, whole + 1, 1) AS INT) // (16 >> rest) * (16 >> rest) AS digit, (16 >> rest) - 1 AS room FROM cut)
SELECT service_id AS seq, '4:' || lpad(printf('%x', low), 8, '0') AS low_key,
  '4:' || lpad(printf('%x', low + CASE WHEN k = 6 THEN 0 ELSE 3 END), 8, '0') AS high_key, NULL AS reason FROM v4
UNION ALL SELECT service_id, '6:' || rpad(head || CASE WHEN rest > 0 THEN printf('%x', digit) ELSE '' END, 32, '0'),
  '6:' || rpad(head || CASE WHEN rest > 0 THEN printf('%x', digit + room) ELSE '' END, 32, 'f'), NULL FROM edges
UNION ALL SELECT service_id, NULL, NULL, unnest(['not a network', 'not an address range']) FROM specs WHERE k = 5""")
def target_ranges(spark, sf_dir):
    """First and last address of every specification, or why there is none."""
    read = targets.parse(_specs(spark, sf_dir)).filter("low_key IS NOT NULL OR reason IS NOT NULL")
    return read.select("seq", "low_key", "high_key", "reason")


LEVEL = "CASE WHEN {0} >= 9 THEN 'critical' WHEN {0} >= 7 THEN 'high' WHEN {0} >= 4 THEN 'medium' WHEN {0} > 0 THEN 'low' ELSE 'none' END"


@query("cve_catalogue", sql=f"""
SELECT lower(p_brand) AS product, CAST(i AS INT) AS position, 'CVE-' || p_partkey || '-' || i AS cve_id, CAST(CASE WHEN i = 0 THEN coalesce(nullif(p_size % 11, 10), 0) ELSE 5 END AS DOUBLE) AS cvss,
  {LEVEL.format("CASE WHEN i = 0 THEN coalesce(nullif(p_size % 11, 10), 0) ELSE 5 END")} AS severity, '<' || p_size || '.0' AS affected,
  CASE WHEN i = 0 THEN p_size || '.0' END AS fixed_version FROM part, (SELECT unnest([0, 1]) AS i)""")
def cve_catalogue(spark, sf_dir):
    """Curated record lists as JSON texts, one for each part."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    record = lambda i, cvss, fixed: F.concat(F.lit('{"cve":"CVE-'), F.col("p_partkey").cast("string"), F.lit(f'-{i}","cvss":'), cvss, F.lit(',"affected":"<'),
                                             F.col("p_size").cast("string"), F.lit('.0"'), fixed, F.lit("}"))
    score = F.coalesce(F.nullif(F.col("p_size") % 11, F.lit(10)).cast("string"), F.lit("null"))
    text = F.concat(F.lit('{"products":{"'), F.col("p_brand"), F.lit('":['), record(0, score, F.concat(F.lit(',"fixed":"'), F.col("p_size").cast("string"), F.lit('.0"'))), F.lit(","),
                    record(1, F.lit("5"), F.lit("")), F.lit("]}}"))
    catalogue = part.select(F.from_json(text, cves.CATALOGUE_SCHEMA).alias("c")).select("c.products")
    return cves.explode_catalogue(catalogue).select("product", "position", "cve_id", "cvss", "severity", "affected", "fixed_version")


@query("cve_nvd", sql=f"""
SELECT lower(p_brand) AS product, CAST(0 AS INT) AS position, 'CVE-' || p_partkey AS cve_id, CAST(CASE WHEN p_partkey % 4 = 3 THEN 0 ELSE p_size % 10 END AS DOUBLE) AS cvss,
  {LEVEL.format("CASE WHEN p_partkey % 4 = 3 THEN 0 ELSE p_size % 10 END")} AS severity, p_type AS summary, p_brand || ' ' || p_size AS affected,
  'https://nvd.nist.gov/vuln/detail/CVE-' || p_partkey AS reference FROM part""")
def cve_nvd(spark, sf_dir):
    """Responses with a score of the newest or an older metric, or none."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    metric = F.concat(F.lit('[{"cvssData":{"baseScore":'), (F.col("p_size") % 10).cast("string"), F.lit("}}]"))
    way = F.col("p_partkey") % 4
    metrics = (F.when(way == 0, F.concat(F.lit('{"cvssMetricV2":[{"cvssData":{"baseScore":1}}],"cvssMetricV31":'), metric, F.lit("}")))
               .when(way == 1, F.concat(F.lit('{"cvssMetricV30":'), metric, F.lit("}"))).when(way == 2, F.concat(F.lit('{"cvssMetricV2":'), metric, F.lit("}"))).otherwise(F.lit("{}")))
    text = F.concat(F.lit('{"vulnerabilities":[{"cve":{"id":"CVE-'), F.col("p_partkey").cast("string"), F.lit('","descriptions":[{"lang":"es","value":"otra"},{"lang":"en","value":"'),
                    F.col("p_type"), F.lit('"}],"metrics":'), metrics, F.lit("}}]}"))
    responses = part.select(F.col("p_brand").alias("product"), F.col("p_size").cast("string").alias("version"), text.alias("value"))
    return cves.parse_nvd(responses).select("product", "position", "cve_id", "cvss", "severity", "summary", "affected", F.col("references")[0].alias("reference"))
