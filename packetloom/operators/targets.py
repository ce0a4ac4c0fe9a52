"""Network specifications → address ranges to join with and asset lists (nothing is contacted)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import ip_key, ipv4_number, ipv4_text, ipv6_text, range_pieces

_CHUNK = 65536


def _key4(number: Column) -> Column:
    return F.concat(F.lit("4:"), F.lower(F.lpad(F.hex(number), 8, "0")))


def _edge6(digits: Column, bits: Column, last: bool) -> Column:
    """First or last address of the IPv6 network that holds an address (32 hexadecimal digits)."""
    whole, rest = F.floor(bits / 4).cast("int"), (bits % 4).cast("int")
    digit = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    step = F.call_function("shiftleft", F.lit(1), 4 - rest)
    first = F.floor(digit / step).cast("int") * step
    cut = F.when(rest > 0, F.lower(F.hex(first + (step - 1 if last else 0)))).otherwise(F.lit(""))
    return F.rpad(F.concat(F.substring(digits, F.lit(1), whole), cut), 32, "f" if last else "0")


def parse(specs: DataFrame, text: str = "spec", seq: str = "spec_id") -> DataFrame:
    """(seq, part, token, form, low, high, low_key, high_key, reason) of every specification.

    Forms: ``net4`` and ``net6`` (``address/length``, any length from 0), ``range4`` (``a.b.c.d-e`` or
    ``a.b.c.d-a.b.c.e``, ends swapped if reversed), ``one`` (an address) and ``name``.  The keys are the first and last
    address as sortable keys, by the same rule for every size.  What looks like a network or a range but is none has
    a reason and no form.
    """
    tokens = specs.select(
        F.col(seq).alias("seq"), F.posexplode(F.filter(F.split(F.translate(text, ",", " "), r"\s+"), lambda t: t != ""))
    ).toDF("seq", "part", "token")
    token = F.col("token")
    head, bits = F.substring_index(token, "/", 1), F.substring_index(token, "/", -1).try_cast("int")
    first, last = F.substring_index(token, "-", 1), F.substring_index(token, "-", -1)
    last = F.when(last.contains("."), last).otherwise(F.concat(F.substring_index(first, ".", 3), F.lit("."), last.try_cast("int").cast("string")))
    is_net, is_range = token.contains("/"), token.rlike(r"^[0-9]+(?:\.[0-9]+){3}-")
    read = tokens.select(
        "seq", "part", "token", bits.alias("bits"), ipv4_number(F.when(is_net, head).otherwise(first)).alias("a"), ipv4_number(last).alias("b"),
        F.when(token.contains(":"), F.substring(ip_key(head), 3, 32)).alias("digits"), is_net.alias("is_net"), (is_range & ~is_net).alias("is_range"))
    form = (
        F.when(F.col("is_net") & F.col("a").isNotNull() & F.col("bits").between(0, 32), F.lit("net4"))
        .when(F.col("is_net") & F.col("digits").isNotNull() & F.col("bits").between(0, 128), F.lit("net6"))
        .when(F.col("is_range") & F.col("a").isNotNull() & F.col("b").isNotNull(), F.lit("range4"))
        .when(~F.col("is_net") & ~F.col("is_range"), F.when(ip_key(token).isNotNull(), F.lit("one")).otherwise(F.lit("name"))))
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), 32 - F.col("bits"))
    base = F.col("a") - F.col("a") % size
    shaped = read.withColumn("form", form)
    shaped = shaped.withColumn("low", F.when(F.col("form") == "net4", base).when(F.col("form") == "range4", F.least("a", "b")))
    shaped = shaped.withColumn("high", F.when(F.col("form") == "net4", base + size - 1).when(F.col("form") == "range4", F.greatest("a", "b")))

    def key(number: Column, last_one: bool) -> Column:
        return (F.when(F.col("form").isin("net4", "range4"), _key4(number)).when(F.col("form") == "one", ip_key(token))
                .when(F.col("form") == "net6", F.concat(F.lit("6:"), _edge6(F.col("digits"), F.col("bits"), last_one))))

    return shaped.select(
        "seq", "part", "token", "form", "bits", "digits", "low", "high", key(F.col("low"), False).alias("low_key"), key(F.col("high"), True).alias("high_key"),
        F.when(F.col("form").isNull(), F.when(F.col("is_net"), F.lit("not a network")).otherwise(F.lit("not an address range"))).alias("reason"))


def ranges(specs: DataFrame, text: str = "spec", seq: str = "spec_id") -> DataFrame:
    """(seq, part, token, low_key, high_key) of every network, range and address, to compare with `ip_key`."""
    return parse(specs, text, seq).filter("low_key IS NOT NULL").select("seq", "part", "token", "low_key", "high_key")


def rejected(specs: DataFrame, text: str = "spec", seq: str = "spec_id") -> DataFrame:
    """(seq, part, token, reason) of what cannot be read."""
    return parse(specs, text, seq).filter("reason IS NOT NULL").select("seq", "part", "token", "reason")


def inside(keys: DataFrame, wanted: DataFrame, key: str = "key") -> DataFrame:
    """Each key with every range (low_key, high_key, ...) it lies in: an interval join by equality, for IPv4 and IPv6.

    A range is cut into the few key prefixes that make it up (one for each hexadecimal digit where it is a network, at
    most thirty for each digit otherwise); a key is looked up once for each length of a prefix that occurs, 33 at most.
    Give distinct keys: an address that a third of all packets have is then looked up once.
    """
    pieces = wanted.withColumn("__piece", F.explode(range_pieces("low_key", "high_key")))
    lengths = pieces.agg(F.sort_array(F.collect_set(F.length("__piece")))).scalar()
    probes = keys.withColumn("__length", F.explode(lengths)).filter(F.col("__length") <= F.length(key)).withColumn(
        "__piece", F.substring(F.col(key), F.lit(1), F.col("__length")))
    return probes.drop("__length").join(pieces, "__piece").drop("__piece")


def unlisted(specs: DataFrame, text: str = "spec", seq: str = "spec_id") -> DataFrame:
    """(seq, part, token, reason) of the networks that `expand` does not list; `ranges` has them."""
    return parse(specs, text, seq).filter("form = 'net6' AND bits < 96").select("seq", "part", "token", F.lit("too many to list").alias("reason"))


def expand(specs: DataFrame, text: str = "spec", seq: str = "spec_id") -> DataFrame:
    """(target, seq, part, host): the hosts of IPv4 networks and ranges, single addresses and names, first occurrence kept.

    Networks go without network and broadcast address where there are hosts in between.  Hosts of IPv6 networks are
    listed below the last 32 bits only (`unlisted` names the others, `ranges` holds them).  What `rejected` names is left out.
    Large networks are first cut into chunks, so one specification spreads over tasks.
    """
    read = parse(specs, text, seq)
    inner = (F.col("form") == "net4") & (F.col("bits") < 31)
    tail = F.conv(F.substring("digits", 25, 8), 16, 10).cast("bigint")
    size6 = F.call_function("shiftleft", F.lit(1).cast("bigint"), 128 - F.col("bits"))
    base6 = tail - tail % size6
    listed6 = (F.col("form") == "net6") & (F.col("bits") >= 96)
    low = F.when(inner, F.col("low") + 1).when(listed6, F.when(F.col("bits") < 127, base6 + 1).otherwise(base6)).otherwise(F.col("low"))
    high = F.when(inner, F.col("high") - 1).when(listed6, base6 + size6 - 1).otherwise(F.col("high"))
    wide = read.withColumn("first", low).withColumn("last", high).withColumn("head", F.when(listed6, F.substring("digits", 1, 24)))
    starts = F.sequence(F.col("first"), F.col("last"), F.lit(_CHUNK).cast("bigint"))
    chunks = wide.filter("first IS NOT NULL").withColumn("chunk", F.explode(starts)).repartition("seq", "chunk")
    v6 = ipv6_text(F.unhex(F.concat("head", F.lpad(F.hex("host"), 8, "0"))))
    hosts = chunks.withColumn("host", F.explode(F.sequence("chunk", F.least(F.col("chunk") + _CHUNK - 1, F.col("last"))))).select(
        F.when(F.col("head").isNotNull(), v6).otherwise(ipv4_text(F.col("host"))).alias("target"), "seq", "part", "host")
    names = wide.filter(F.col("form").isin("one", "name")).select(F.col("token").alias("target"), "seq", "part", F.lit(0).cast("bigint").alias("host"))
    return hosts.unionByName(names).groupBy("target").agg(F.min(F.struct("seq", "part", "host")).alias("o")).select("target", "o.*")
