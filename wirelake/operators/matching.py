"""Matching against reference sets: equality, domain suffixes, address blocks, parts of a text.

Sets built in are small constants and broadcast; a set handed in as a DataFrame joins as the planner likes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake import refdata
from wirelake.functions.scalars import ipv4_number


def _set(spark: SparkSession, given: DataFrame | None, rows: list, schema: str) -> DataFrame:
    return given if given is not None else F.broadcast(refdata.frame(spark, rows, schema))


def flag_threat_ips(df: DataFrame, threats: DataFrame | None = None) -> DataFrame:
    """Adds src_is_blacklisted and dst_is_blacklisted."""
    given = threats is not None
    threats = threats.select("ip").distinct() if given else refdata.frame(df.sparkSession, refdata.THREAT_IPS, "ip string")
    for side in ("src", "dst"):
        listed = threats.select(F.col("ip").alias(f"_{side}"), F.lit(True).alias(f"_{side}_bad"))
        df = df.join(listed if given else F.broadcast(listed), F.col(f"{side}_ip") == F.col(f"_{side}"), "left")
        df = df.withColumn(f"{side}_is_blacklisted", F.coalesce(f"_{side}_bad", F.lit(False))).drop(f"_{side}", f"_{side}_bad")
    return df


def suffixes(name: Column) -> Column:
    """The domain and all its parents: a.b.c, b.c, c."""
    parts = F.split(F.lower(F.regexp_replace(name, r"\.$", "")), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def threat_domains(df: DataFrame, column: str = "query", domains: DataFrame | None = None) -> DataFrame:
    """Rows whose name equals a listed domain or lies below one, each once, with the longest such domain.

    Names become distinct first; only they are exploded into suffixes and joined by equality.
    """
    domains = _set(df.sparkSession, domains, refdata.THREAT_DOMAINS, "domain string")
    names = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("_name")).distinct()
    hits = names.withColumn("_suffix", F.explode(suffixes(F.col("_name")))).join(domains, F.col("_suffix") == F.col("domain"))
    longest = hits.groupBy("_name").agg(F.max_by("domain", F.struct(F.length("domain"), "domain")).alias("domain"))
    return df.join(longest, F.col(column) == F.col("_name")).drop("_name")


def unknown_external_domains(df: DataFrame, column: str = "query", domains: DataFrame | None = None) -> DataFrame:
    """Names and their counts that are neither a known domain nor below one; names first become distinct."""
    domains = _set(df.sparkSession, domains, refdata.KNOWN_DOMAINS, "domain string")
    names = df.filter(F.col(column).isNotNull() & ~F.col(column).isin("", "-")).groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    known = names.withColumn("_suffix", F.explode(suffixes(F.col("name")))).join(domains, F.col("_suffix") == F.col("domain"), "left_semi").select(F.col("name").alias("known")).distinct()
    return names.join(known, F.col("name") == F.col("known"), "left_anti")


def new_asset_resource_pairs(http: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of source and path (without the query) that are not known yet."""
    pairs = learn_pairs(http)
    return pairs.join(known.select("asset_id", "resource_path"), ["asset_id", "resource_path"], "left_anti")


def learn_pairs(http: DataFrame, known: DataFrame | None = None) -> DataFrame:
    pairs = http.select(F.col("src_ip").alias("asset_id"), F.substring_index("uri", "?", 1).alias("resource_path")).filter("asset_id IS NOT NULL AND resource_path IS NOT NULL")
    return (pairs if known is None else pairs.unionByName(known.select("asset_id", "resource_path"))).distinct()


def blocks(spark: SparkSession, rows: list[list[str]]) -> DataFrame:
    """Addresses and CIDR blocks as number ranges: block, owner, low, high, and the /16 groups they lie in."""
    listed = refdata.frame(spark, rows, "block string,owner string")
    bits = F.coalesce(F.regexp_extract("block", r"/(\d+)$", 1).try_cast("int"), F.lit(32))
    low = ipv4_number(F.substring_index("block", "/", 1))
    size = F.pow(F.lit(2.0), F.lit(32) - bits).cast("long")
    out = listed.select("block", "owner", (F.floor(low / size) * size).cast("long").alias("low"), (F.floor(low / size) * size + size - 1).cast("long").alias("high"))
    return out.withColumn("group16", F.explode(F.sequence(F.floor(F.col("low") / 65536), F.floor(F.col("high") / 65536))))


def _numbered(df: DataFrame, column: str) -> DataFrame:
    """df with _number, of the address, and _group, its /16."""
    # a generator's output is worked out once: conditions on it can't pull the split into themselves
    rows = df.withColumn("_number", F.explode(F.array(ipv4_number(F.col(column)))))
    return rows.withColumn("_group", F.floor(F.col("_number") / 65536))


def scanner_hits(df: DataFrame, column: str = "src_ip", scanners: DataFrame | None = None) -> DataFrame:
    """Rows whose address lies in a scanner's block: joined by /16 group, then by range."""
    scanners = scanners if scanners is not None else F.broadcast(blocks(df.sparkSession, refdata.SCANNERS))
    rows = _numbered(df, column)
    return rows.join(scanners, (F.col("_group") == F.col("group16")) & F.col("_number").between(F.col("low"), F.col("high"))).drop("_number", "_group", "group16", "low", "high")


def suppress_scanners(df: DataFrame, column: str = "src_ip", scanners: DataFrame | None = None) -> DataFrame:
    """The rows without those from scanners."""
    scanners = scanners if scanners is not None else F.broadcast(blocks(df.sparkSession, refdata.SCANNERS))
    rows = _numbered(df, column)
    return rows.join(scanners, (F.col("_group") == F.col("group16")) & F.col("_number").between(F.col("low"), F.col("high")), "left_anti").drop("_number", "_group")


def matches_any(text: Column, patterns: list[str]) -> Column:
    """Whether a text holds any of the parts, whatever the case: one alternation."""
    return F.coalesce(text.rlike("(?i)" + "|".join(re.sub(r"([^A-Za-z0-9 /_%=-])", r"\\\1", p) for p in patterns)), F.lit(False))


def first_match(text: Column, patterns: list[str]) -> Column:
    """The first pattern of the list that a text holds."""
    low = F.lower(text)
    return F.coalesce(*(F.when(F.contains(low, F.lit(p.lower())), p) for p in patterns))


def suspicious_user_agents(http: DataFrame) -> DataFrame:
    hit = http.filter(matches_any(F.col("user_agent"), refdata.SUSPICIOUS_AGENTS))
    return hit.withColumn("pattern", first_match(F.col("user_agent"), refdata.SUSPICIOUS_AGENTS))


def sqli_patterns(http: DataFrame) -> DataFrame:
    """On the decoded URI; one that can't be decoded is taken as it is."""
    uri = F.coalesce(F.try_url_decode("uri"), F.col("uri"))
    return http.filter(matches_any(uri, refdata.SQLI_PATTERNS)).withColumn("pattern", first_match(uri, refdata.SQLI_PATTERNS))


def webshell_paths(http: DataFrame) -> DataFrame:
    uri = F.coalesce(F.try_url_decode("uri"), F.col("uri"))
    return http.filter(matches_any(uri, refdata.WEBSHELL_PATHS)).withColumn("pattern", first_match(uri, refdata.WEBSHELL_PATHS))


def rare_ja3(ssl: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    listed = _set(ssl.sparkSession, listed, refdata.RARE_JA3, "rare_ja3 string,tool string")
    return ssl.join(listed, F.col("ja3") == F.col("rare_ja3")).drop("rare_ja3")


def nonstandard_port(df: DataFrame, service: str = "service", ports: DataFrame | None = None) -> DataFrame:
    """A known service on a port that is none of its own."""
    ports = _set(df.sparkSession, ports, [[s, p] for s, p in refdata.STANDARD_PORTS], "known_service string,known_port int")
    known = df.join(ports, F.col(service) == F.col("known_service"), "left_semi")
    return known.join(ports, (F.col(service) == F.col("known_service")) & (F.col("dst_port") == F.col("known_port")), "left_anti")


def extension_mime_mismatch(df: DataFrame, name: str = "filename", mime: str = "mime_type") -> DataFrame:
    """Files whose type is not that of their extension."""
    kinds = F.broadcast(refdata.frame(df.sparkSession, refdata.EXTENSION_TYPES, "extension string,expected string"))
    rows = df.withColumn("_extension", F.lower(F.regexp_extract(F.col(name), r"(\.[A-Za-z0-9]+)$", 1)))
    return rows.join(kinds, F.col("_extension") == F.col("extension")).filter(F.col(mime).isNotNull() & (F.lower(F.col(mime)) != F.col("expected"))).drop("_extension")


def suspicious_attachments(df: DataFrame, name: str = "filename") -> DataFrame:
    kinds = F.broadcast(refdata.frame(df.sparkSession, refdata.ATTACHMENT_TYPES, "extension string"))
    return df.join(kinds, F.lower(F.regexp_extract(F.col(name), r"(\.[A-Za-z0-9]+)$", 1)) == F.col("extension"), "left_semi")


def ssl_notices(notices: DataFrame) -> DataFrame:
    return notices.join(F.broadcast(refdata.frame(notices.sparkSession, refdata.SSL_NOTICES, "listed string")), F.col("note") == F.col("listed"), "left_semi")


def threat_asns(df: DataFrame, column: str = "geo_asn") -> DataFrame:
    return df.join(F.broadcast(refdata.frame(df.sparkSession, refdata.THREAT_ASNS, "listed string")), F.upper(F.col(column)) == F.col("listed"), "left_semi")
