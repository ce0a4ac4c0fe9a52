"""Threat feeds: plain-text lists and web pages → addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Address patterns and comment marks.
LISTED = r"^(?:\d{1,3}\.){3}\d{1,3}(?:/\d{1,2})?$"
ANYWHERE = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
COMMENT_MARKS = ("#", ";", "//")
_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def _payload_line(line: Column) -> Column:
    """Trimmed line, null for blank lines and comments."""
    text = F.regexp_replace(line, r"^\s+|\s+$", "")
    keep = text != ""
    for mark in COMMENT_MARKS:
        keep = keep & ~text.startswith(mark)
    return F.when(keep, text)


def _listed_ip(text: Column) -> Column:
    token = F.trim(F.split(F.split(text, r"\s+")[0], ";")[0])
    return F.when(token.rlike(LISTED), F.substring_index(token, "/", 1))


def _valid(ip: Column) -> Column:
    return F.forall(F.split(ip, r"\."), lambda octet: octet.cast("int") <= 255)


def parse_listed(lines: DataFrame, line: str = "value") -> DataFrame:
    """Strict form: the first token of a line must be an address or network (prefix length dropped)."""
    others = [c for c in lines.columns if c != line]
    return lines.select(*others, _listed_ip(_payload_line(F.col(line))).alias("ip")).filter("ip IS NOT NULL")


def parse_any(lines: DataFrame, line: str = "value") -> DataFrame:
    """Default form: else any address in the line; octets are checked."""
    others = [c for c in lines.columns if c != line]
    text = _payload_line(F.col(line))
    found = F.nullif(F.regexp_extract(text, ANYWHERE, 0), F.lit(""))
    ips = lines.select(*others, F.coalesce(_listed_ip(text), found).alias("ip")).filter("ip IS NOT NULL")
    return ips.filter(_valid(F.col("ip")))


def lines_of(df: DataFrame, text: str) -> DataFrame:
    """Explode a text column into its lines, ``value`` with the line number ``line_no``."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(F.split(text, _LINE_BREAK)).alias("line_no", "value"))


def page_text(html: Column) -> Column:
    """Text of the body of a page, tags as blanks."""
    body = F.regexp_replace(html, r"(?is)^.*?<body[^>]*>|</body\s*>.*$", " ")
    return F.regexp_replace(body, r"(?s)<!--.*?-->|<[^>]*>", " ")


def parse_pages(pages: DataFrame, html: str = "html", source: str = "url") -> DataFrame:
    """Every address-looking token of a page's text; octets are not checked."""
    ips = F.regexp_extract_all(page_text(F.col(html)), F.lit("(" + ANYWHERE + ")"), F.lit(1))
    return pages.select(F.explode(ips).alias("ip"), F.col(source).alias("source"))


def read_lists(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Address lists from files; the file is the source.  Each address is kept once per source."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source"))
    parsed = parse_listed(lines) if strict else parse_any(lines)
    return parsed.select("ip", "source").distinct()
