"""Vulnerability records: curated JSON by product, and downloaded NVD 2.0 responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.severity import cvss_severity

_RECORD = ("struct<cve:string,cvss:double,severity:string,affected:string,fixed:string,summary:string,"
           "references:array<string>>")
CATALOGUE_SCHEMA = f"products map<string,array<{_RECORD}>>"
_METRIC = "array<struct<cvssData:struct<baseScore:double>>>"
NVD_SCHEMA = (
    "vulnerabilities array<struct<cve:struct<id:string,descriptions:array<struct<lang:string,value:string>>,"
    f"metrics:struct<cvssMetricV31:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV2:{_METRIC}>>>>"
)
# Fixed value: reference page of a record.
DETAIL_PAGE = "https://nvd.nist.gov/vuln/detail/"


def _shape(rows: DataFrame) -> DataFrame:
    cvss = F.coalesce("cvss", F.lit(0.0))
    return rows.select(
        F.lower("product").alias("product"), "position", F.coalesce("cve_id", F.lit("")).alias("cve_id"), cvss.alias("cvss"),
        F.coalesce(F.nullif("severity", F.lit("")), cvss_severity(cvss)).alias("severity"),
        F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("affected", F.lit("")).alias("affected"),
        "fixed_version", F.coalesce("references", F.array().cast("array<string>")).alias("references"),
    )


def explode_catalogue(catalogue: DataFrame) -> DataFrame:
    """One row per product and record; ``position`` keeps the order of the list."""
    per_product = catalogue.select(F.explode("products").alias("product", "records"))
    return _shape(per_product.select("product", F.posexplode("records").alias("position", "r")).select(
        "product", "position", F.col("r.cve").alias("cve_id"), "r.cvss", "r.severity", "r.summary", "r.affected",
        F.col("r.fixed").alias("fixed_version"), "r.references"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return explode_catalogue(spark.read.schema(CATALOGUE_SCHEMA).json(path, multiLine=True))


def parse_nvd(responses: DataFrame, text: str = "value") -> DataFrame:
    """NVD response texts with ``product`` and ``version`` columns → records affecting that version."""
    def score(name: str) -> Column:
        entry = F.get(F.col(f"cve.metrics.{name}"), F.lit(0))
        return F.when(entry.isNotNull(), F.coalesce(entry["cvssData"]["baseScore"], F.lit(0.0)))

    english = F.get(F.filter("cve.descriptions", lambda d: d["lang"] == "en"), F.lit(0))["value"]
    items = responses.select(
        "product", "version", F.posexplode(F.from_json(text, NVD_SCHEMA)["vulnerabilities"]).alias("position", "v")
    ).select("product", "version", "position", F.col("v.cve").alias("cve"))
    rows = items.select(
        "product", "position", F.col("cve.id").alias("cve_id"),
        F.coalesce(score("cvssMetricV31"), score("cvssMetricV30"), score("cvssMetricV2"), F.lit(0.0)).alias("cvss"),
        F.lit(None).cast("string").alias("severity"), english.alias("summary"),
        F.concat_ws(" ", "product", "version").alias("affected"), F.lit(None).cast("string").alias("fixed_version"),
        F.when(F.col("cve.id") != "", F.array(F.concat(F.lit(DETAIL_PAGE), F.col("cve.id")))).alias("references"),
    )
    return _shape(rows)
