"""Product identification, version order and version-range constraints.

A version becomes an array of ``(kind, length, text)`` structs.  Spark orders arrays of
structs element by element and puts a prefix first, which is exactly the order needed, so
comparisons are plain ``<``, ``=``, ``>`` on columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import lookup
from .net import _let

# Banner signatures in match order (service, product, pattern, has a version group).
BANNER_SIGNATURES = (
    ("ssh", "OpenSSH", r"OpenSSH[_/ ]([0-9][0-9a-zA-Z._]*)", True),
    ("ssh", "Dropbear", r"dropbear[_/ ]([0-9][0-9a-zA-Z._]*)", True),
    ("http", "Apache httpd", r"Apache/([0-9][0-9a-zA-Z._]*)", True),
    ("http", "nginx", r"nginx/([0-9][0-9a-zA-Z._]*)", True),
    ("http", "Microsoft-IIS", r"Microsoft-IIS/([0-9][0-9.]*)", True),
    ("http", "lighttpd", r"lighttpd/([0-9][0-9a-zA-Z._]*)", True),
    ("http", "Jetty", r"Jetty\(([0-9][0-9a-zA-Z._]*)", True),
    ("ftp", "vsftpd", r"vsftpd ([0-9][0-9a-zA-Z._]*)", True),
    ("ftp", "ProFTPD", r"ProFTPD ([0-9][0-9a-zA-Z._]*)", True),
    ("ftp", "Pure-FTPd", r"Pure-FTPd", False),
    ("ftp", "FileZilla", r"FileZilla Server ([0-9][0-9a-zA-Z._]*)", True),
    ("smtp", "Exim", r"Exim ([0-9][0-9a-zA-Z._]*)", True),
    ("smtp", "Postfix", r"Postfix", False),
    ("smtp", "Sendmail", r"Sendmail ([0-9][0-9a-zA-Z._/]*)", True),
    ("mysql", "MariaDB", r"([0-9][0-9a-zA-Z._]*)-MariaDB", True),
    ("mysql", "MySQL", r"([0-9]+\.[0-9]+\.[0-9][0-9a-zA-Z._]*)", True),
    ("smb", "Samba", r"Samba ([0-9][0-9a-zA-Z._]*)", True),
    ("pop3", "Dovecot", r"Dovecot", False),
    ("redis", "Redis", r"redis_version:([0-9][0-9a-zA-Z._]*)", True),
    ("memcached", "Memcached", r"VERSION ([0-9][0-9a-zA-Z._]*)", True),
    ("ssl", "OpenSSL", r"OpenSSL/([0-9][0-9a-zA-Z._]*)", True),
)

# Newest known version per lower-cased product.
LATEST_VERSIONS = {
    "openssh": "9.8p1", "dropbear": "2022.83", "apache httpd": "2.4.62", "nginx": "1.27.1",
    "microsoft-iis": "10.0", "lighttpd": "1.4.76", "vsftpd": "3.0.5", "proftpd": "1.3.8",
    "exim": "4.98", "sendmail": "8.18.1", "mysql": "8.4.2", "mariadb": "11.4.3",
    "samba": "4.20.2", "redis": "7.4.0", "memcached": "1.6.31", "openssl": "3.3.2",
}


def identify_product(banner: Column, specific_first: bool = False) -> Column:
    """Banner → struct(service, product, version) of the first matching signature, else null.

    The generic three-part MySQL pattern shadows later signatures; ``specific_first``
    moves it to the end instead.
    """
    signatures = list(BANNER_SIGNATURES)
    if specific_first:
        signatures.sort(key=lambda s: s[1] == "MySQL")
    chain = None
    for number, (_, _, pattern, _) in enumerate(signatures, start=1):
        hit = banner.rlike("(?i)" + pattern)
        chain = F.when(hit, number) if chain is None else chain.when(hit, number)
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i)

    def found(i: Column) -> Column:
        # one extraction by the pattern that matched: a branch for each would be more code than Spark compiles
        pattern = pick([f"(?i){p}" if versioned else None for _, _, p, versioned in signatures], i)
        return F.when(i.isNotNull(), F.struct(
            pick([s for s, _, _, _ in signatures], i).alias("service"), pick([p for _, p, _, _ in signatures], i).alias("product"),
            F.call_function("regexp_extract", banner, pattern, F.lit(1)).alias("version")))

    return _let(chain, found)


def version_key(version: Column) -> Column:
    """Sortable text: digit runs compare as numbers of any length (without leading zeros: by length, then as
    text) and above letter runs, a version before its continuations.

    A digit run is written as ``1``, its length in nine digits and the digits; a letter run as ``0``, the letters and a mark
    below all letters.  So a comparison of two versions is one comparison of two texts.
    """
    tokens = F.regexp_extract_all(F.lower(version), F.lit("([0-9]+|[a-z]+)"), F.lit(1))

    def element(token: Column) -> Column:
        bare = F.ltrim(token, F.lit("0"))
        number = F.concat(F.lit("1"), F.lpad(F.length(bare).cast("string"), 9, "0"), bare)
        return F.when(token.rlike("^[0-9]"), number).otherwise(F.concat(F.lit("0"), token, F.lit("!")))

    return F.array_join(F.transform(tokens, element), "")


def parse_constraints(text: Column) -> Column:
    """Constraint text → array of (op, key).  A part that is only an operator is skipped."""
    parts = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), ",", " "), r"\s+"), lambda p: p != "")

    def parse(part: Column) -> Column:
        def named(op: Column) -> Column:
            return _let(F.trim(F.substring(part, F.length(op) + 1, F.length(part))), lambda target: F.struct(
                op.alias("op"), target.alias("target"), version_key(target).alias("key")))

        return _let(F.regexp_extract(part, r"^(<=|>=|==|!=|<|>|=)", 1), named)

    return F.filter(F.transform(parts, parse), lambda c: c["target"] != "")


def satisfies_parsed(version: Column, key: Column, text: Column, constraints: Column) -> Column:
    """Does a version (with its key) meet every parsed constraint?

    An absent constraint holds for any non-empty version; an empty version meets none.
    """
    def holds(c: Column) -> Column:
        op, target = c["op"], c["key"]
        return (
            F.when(op == "<", key < target)
            .when(op == "<=", key <= target)
            .when(op == ">", key > target)
            .when(op == ">=", key >= target)
            .when(op == "!=", key != target)
            .otherwise(key == target)
        )

    given = F.coalesce(F.trim(version) != "", F.lit(False))
    free = F.coalesce(text, F.lit("")) == ""
    return given & (free | F.coalesce(F.forall(constraints, holds), F.lit(False)))


def satisfies(version: Column, constraint: Column) -> Column:
    return _let(version_key(version), lambda key: satisfies_parsed(version, key, constraint, parse_constraints(constraint)))


def latest_version(product: Column) -> Column:
    return lookup(F.lower(product), LATEST_VERSIONS)


def is_outdated(version: Column, latest: Column) -> Column:
    """Older than the newest known version; false when either side is unknown."""
    known = (F.coalesce(version, F.lit("")) != "") & latest.isNotNull()
    return F.coalesce(known & (version_key(version) < version_key(latest)), F.lit(False))


def cpe(product: Column, version: Column) -> Column:
    name = F.translate(F.lower(product), " -", "__")
    text = F.when(F.coalesce(version, F.lit("")) == "", F.lit("*")).otherwise(version)
    return F.when(
        F.coalesce(product, F.lit("")) != "",
        F.concat(F.lit("cpe:2.3:a:"), name, F.lit(":"), name, F.lit(":"), text, F.lit(":*:*:*:*:*:*:*")),
    )
