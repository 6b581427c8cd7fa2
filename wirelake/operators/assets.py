"""Asset profiles: algebraic counters per host, so batches and streams merge; cards and fleet views over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake import refdata
from wirelake.functions import scalars as S
from wirelake.operators import identity
from wirelake.operators.common import cut, page, top

COUNTERS = ("total_events", "conn_in", "conn_out", "dns_queries", "http_requests", "ssl_connections", "ssh_sessions", "bytes_out", "bytes_in")


def sides(lake: dict[str, DataFrame]) -> DataFrame:
    """Each event once for its source and once for its destination, where that is a trackable address."""
    parts = []
    for name, df in lake.items():
        null = F.lit(None).cast("long")
        bytes_of = (F.col("orig_bytes").cast("long"), F.col("resp_bytes").cast("long")) if name == "conn" else (null, null)
        parts.append(df.select(F.lit(name).alias("log_type"), "src_ip", "dst_ip", "event_time", bytes_of[0].alias("orig_bytes"), bytes_of[1].alias("resp_bytes")))
    rows = reduce(DataFrame.unionByName, parts)
    one = lambda role, ip, peer: F.struct(F.lit(role).alias("role"), F.trim(F.col(ip)).alias("ip"), F.trim(F.col(peer)).alias("peer"))
    both = rows.withColumn("side", F.explode(F.array(one("src", "src_ip", "dst_ip"), one("dst", "dst_ip", "src_ip"))))
    return both.select("log_type", "event_time", "orig_bytes", "resp_bytes", "side.role", "side.ip", "side.peer").filter(S.is_trackable_ip(F.col("ip")))


#: Sketches of different peers: 2**SKETCH registers, about one per cent of error, and exact for few peers.
SKETCH = 13


def counters(rows: DataFrame, *keys: Column, sketched: bool = False, by: str = "ip") -> DataFrame:
    """The additive part of a profile, by address or another column (and more keys): counts, times, and, sketched, mergeable sketches of its peers.

    peers_out and peers_in hold the different trackable destinations and sources.
    """
    src = F.col("role") == "src"
    of = lambda kind: F.count_if(src & (F.col("log_type") == kind))
    conn = src & (F.col("log_type") == "conn")
    peer = lambda role: F.when((F.col("role") == role) & S.is_trackable_ip(F.col("peer")), F.col("peer"))
    sketches = [F.hll_sketch_agg(peer(role), F.lit(SKETCH)).alias(name) for role, name in (("src", "peers_out"), ("dst", "peers_in"))] if sketched else []
    return rows.groupBy(by, *keys).agg(
        *sketches,
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(~src).alias("conn_in"),
        F.count_if(src).alias("conn_out"),
        of("dns").alias("dns_queries"),
        of("http").alias("http_requests"),
        of("ssl").alias("ssl_connections"),
        of("ssh").alias("ssh_sessions"),
        F.sum(F.when(conn, F.coalesce("orig_bytes", F.lit(0))).otherwise(0)).alias("bytes_out"),
        F.sum(F.when(conn, F.coalesce("resp_bytes", F.lit(0))).otherwise(0)).alias("bytes_in"),
        F.min("event_time").alias("first_seen"),
        F.max("event_time").alias("last_seen"),
    )


def asset_profiles(lake: dict[str, DataFrame], sketched: bool = False) -> DataFrame:
    return counters(sides(lake), sketched=sketched)


def profiles_by_asset(lake: dict[str, DataFrame], bindings: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Profiles by asset_id, through all addresses that an asset has had, with last_ip, the address of its last event.

    ids: of identity.asset_ids; without them the assets are those of the bindings and of the addresses without a lease.
    """
    # what an address does while one MAC holds it meets in one partial profile: the events are looked up once and move no further
    parts = cut(counters(identity.resolve_ip(sides(lake), bindings, "ip"), F.col("mac")), "parts")
    if ids is None:
        ids = identity.asset_ids(identity.mac_assets(bindings), parts.filter("mac IS NULL").select("ip", "first_seen"))
    by_mac = ids.filter("mac IS NOT NULL").select(F.col("mac").alias("_key"), "asset_id")
    by_ip = ids.filter("ip IS NOT NULL").select(F.col("ip").alias("_key"), "asset_id")
    held = parts.join(by_mac, F.col("mac") == F.col("_key")).unionByName(parts.filter("mac IS NULL").join(by_ip, F.col("ip") == F.col("_key")))
    last = F.max(F.struct("last_seen", "ip"))["ip"].alias("last_ip")
    return held.filter("asset_id IS NOT NULL").groupBy("asset_id").agg(*(F.sum(c).alias(c) for c in COUNTERS), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), last)


PEERS = ("peers_out", "peers_in")


def merge_profiles(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Profiles of all events from those of a part and of the rest; sketches where both have them."""
    held = [*COUNTERS, "first_seen", "last_seen", *(p for p in PEERS if p in old.columns and p in delta.columns)]
    return summed(old.select("ip", *held).unionByName(delta.select("ip", *held)))


def summed(parts: DataFrame) -> DataFrame:
    """One profile of each address from any number of its parts."""
    sketches = [F.hll_union_agg(p).alias(p) for p in PEERS if p in parts.columns]
    return parts.groupBy("ip").agg(*(F.sum(c).alias(c) for c in COUNTERS), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), *sketches)


def peer_estimates(profiles: DataFrame) -> DataFrame:
    """ip, destinations, sources: different peers as the sketches tell.

    A sketch that took its rows in one go estimates by their order too, one that was merged by its registers alone; merged with
    itself each does the latter, so the numbers follow from the peers, however the rows were dealt.
    """
    n = lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_union(c, c)), F.lit(0).cast("long"))
    return profiles.select("ip", n("peers_out").alias("destinations"), n("peers_in").alias("sources"))


def unique_peers(lake: dict[str, DataFrame], approximate: bool = False) -> DataFrame:
    """Different trackable destinations and sources of each address, of those that have any; exact, or by sketches."""
    rows = sides(lake).filter(S.is_trackable_ip(F.col("peer")))
    if approximate:
        return peer_estimates(counters(rows, sketched=True))
    pairs = rows.select("ip", "role", "peer").distinct()
    return pairs.groupBy("ip").agg(F.count_if(F.col("role") == "src").alias("destinations"), F.count_if(F.col("role") == "dst").alias("sources"))


def mac_vendor(df: DataFrame) -> DataFrame:
    """Adds vendor by the first 8 characters of mac as they are."""
    vendors = F.broadcast(refdata.frame(df.sparkSession, refdata.OUI_VENDORS, "oui string,vendor string"))
    return df.join(vendors, F.substring("mac", 1, 8) == F.col("oui"), "left").drop("oui")


def ja3_app(df: DataFrame) -> DataFrame:
    apps = F.broadcast(refdata.frame(df.sparkSession, refdata.JA3_APPS, "known_ja3 string,app string"))
    return df.join(apps, F.col("ja3") == F.col("known_ja3"), "left").drop("known_ja3")


def identity_attributes(bindings: DataFrame, ssl: DataFrame, http: DataFrame, ntlm: DataFrame | None = None, kerberos: DataFrame | None = None) -> DataFrame:
    """Per address: mac (last binding), vendor (first known), hostname (last named), app (first known), os_hint (first known).

    A host name is the last of leases and NTLM, else the first Kerberos client. Vendors go by the MAC as its event wrote it,
    where the bindings hold that (raw_mac).
    """
    at = lambda c: F.struct("event_time", c)
    written = bindings.withColumn("mac", F.col("raw_mac")) if "raw_mac" in bindings.columns else bindings
    vendors = mac_vendor(written).withColumn("mac", F.upper("mac"))
    a = vendors.groupBy("ip").agg(
        F.max(at("mac"))["mac"].alias("mac"),
        F.min(F.when(F.col("vendor").isNotNull(), at("vendor")))["vendor"].alias("vendor"),
        F.max(F.when(F.col("hostname") != "", at("hostname")))["hostname"].alias("hostname"),
    )
    b = ja3_app(ssl).filter("app IS NOT NULL").groupBy(F.col("src_ip").alias("ip")).agg(F.min(at("app"))["app"].alias("app"))
    os = http.withColumn("os", S.os_from_user_agent(F.col("user_agent"))).filter("os <> ''")
    c = os.groupBy(F.col("src_ip").alias("ip")).agg(F.min(at("os"))["os"].alias("os_hint"))
    out = a.join(b, "ip", "full").join(c, "ip", "full")
    if ntlm is None and kerberos is None:
        return out
    none = bindings.select(F.col("ip").alias("src_ip"), "event_time", F.lit("").alias("name")).limit(0)
    told = none if ntlm is None else ntlm.select("src_ip", "event_time", F.col("hostname").alias("name"))
    clients = none if kerberos is None else kerberos.select("src_ip", "event_time", F.col("client").alias("name"))
    names = bindings.select(F.col("ip").alias("src_ip"), "event_time", F.col("hostname").alias("name")).unionByName(told).filter("name <> ''")
    last = names.groupBy(F.col("src_ip").alias("ip")).agg(F.max(at("name"))["name"].alias("_last"))
    first = clients.filter("name <> ''").groupBy(F.col("src_ip").alias("ip")).agg(F.min(at("name"))["name"].alias("_first"))
    out = out.join(last, "ip", "full").join(first, "ip", "full")
    return out.withColumn("hostname", F.coalesce("_last", "_first")).drop("_last", "_first")


def asset_type(vendor: Column, conn_in: Column, conn_out: Column, ssh: Column) -> Column:
    """The first vendor rule that fits, then traffic, then SSH, else workstation."""
    v = F.lower(F.coalesce(vendor, F.lit("")))
    rules = [F.when(F.contains(v, F.lit(part)), kind) for part, kind in refdata.VENDOR_TYPES]
    traffic = F.when((conn_in > 3 * conn_out) & (conn_in > 50), "server").when((ssh > 10) & (conn_in > conn_out), "server")
    return F.coalesce(*rules, traffic, F.lit("workstation"))


def classify_assets(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("asset_type", asset_type(F.col("vendor"), F.col("conn_in"), F.col("conn_out"), F.col("ssh_sessions")))


def role_index(assets: DataFrame) -> DataFrame:
    """Assets of each type. One row per type and asset: a set of a whole type could not be held in one value."""
    return assets.select("asset_type", "ip").distinct()


def mac_index(bindings: DataFrame) -> DataFrame:
    """The last address of each MAC."""
    return bindings.groupBy("mac").agg(F.max_by("ip", F.struct("event_time", "ip")).alias("ip"))


def asset_summary(lake: dict[str, DataFrame]) -> DataFrame:
    """Per address as source: events, share of each protocol table in percent, 24 hours of activity."""
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("log_type"), F.col("src_ip").alias("ip"), S.hour_of(F.col("event_time")).alias("hour")) for n, df in lake.items()])
    kinds = [F.round(100.0 * F.count_if(F.col("log_type") == n) / F.count(F.lit(1)), 1).alias(f"{n}_pct") for n in lake]
    hours = [F.count_if(F.col("hour") == h) for h in range(24)]
    return rows.groupBy("ip").agg(F.count(F.lit(1)).alias("total_events"), *kinds, F.array(*hours).alias("hourly"))


def asset_top(df: DataFrame, value: str, n: int = 5, key: str = "src_ip") -> DataFrame:
    """The most common values of each address."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n)


def rare_ports(conn: DataFrame, n: int = 5) -> DataFrame:
    """The least used destination ports of each source."""
    counts = conn.groupBy("src_ip", "dst_port").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("src_ip").orderBy("n", "dst_port"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n)


def protocol_shares(profiles: DataFrame) -> DataFrame:
    """Shares of the four counted protocols among themselves, in percent."""
    parts = ("dns_queries", "http_requests", "ssl_connections", "ssh_sessions")
    total = reduce(lambda a, b: a + b, map(F.col, parts))
    return profiles.select("ip", *(F.when(total > 0, F.round(100.0 * F.col(p) / total, 1)).otherwise(0.0).alias(p.split("_")[0] + "_pct") for p in parts))


MATURITY_FIELDS = ("ip", "hostname", "mac", "vendor", "os_hint", "asset_type", "first_seen", "last_seen", "app", "total_events")


def maturity(cards: DataFrame) -> DataFrame:
    """Known ones of ten fields as a score of 100, half to even, and its band."""
    known = reduce(lambda a, b: a + b, [F.coalesce((F.col(c).cast("string") != "") & (F.col(c).cast("string") != "unknown"), F.lit(False)).cast("int") for c in MATURITY_FIELDS])
    score = F.bround(100.0 * known / len(MATURITY_FIELDS)).cast("int")
    band = F.when(score >= 70, "mature").when(score >= 40, "learning").otherwise("sparse")
    return cards.withColumn("maturity", score).withColumn("maturity_band", band)


def behavior(cards: DataFrame) -> DataFrame:
    """From hourly (24 counts) and counters: active hours, peak, patterns, flags."""
    peak = F.array_max("hourly")
    active = F.when(peak > 0, F.size(F.filter("hourly", lambda x: x >= peak * 0.3))).otherwise(0)
    hour = F.when(peak > 0, (F.array_position("hourly", peak) - 1).cast("int")).otherwise(0)
    rows = cards.withColumn("active_hours", active).withColumn("peak_hour", hour)
    server = F.col("active_hours") >= 20
    out_ratio = F.col("conn_out") / (F.col("conn_in") + F.col("conn_out"))
    return rows.select(
        "ip", "active_hours", "peak_hour", server.alias("server_pattern"),
        (~server & F.col("peak_hour").between(8, 20) & (F.col("active_hours") >= 6)).alias("workstation_pattern"),
        F.coalesce((F.col("conn_in") > 0) & (F.col("conn_out") > 0) & (out_ratio > 0.85) & (F.col("bytes_out") > 10_000_000), F.lit(False)).alias("high_outbound"),
        (F.col("dns_queries") > 5000).alias("high_dns"),
        (((F.col("peak_hour") < 6) | (F.col("peak_hour") >= 22)) & (F.array_max("hourly") > 50)).alias("off_hours"),
    )


def asset_card(profiles: DataFrame, risk: DataFrame) -> DataFrame:
    """Profile with events a second, connections, ratio and risk level. risk: ip, risk_score."""
    seconds = (F.col("last_seen") - F.col("first_seen")) / 1000
    rows = profiles.join(risk, "ip", "left").withColumn("risk_score", F.coalesce("risk_score", F.lit(0)))
    eps = F.when(seconds > 0, F.round(F.col("total_events") / seconds, 2)).otherwise(0.0)
    ratio = F.when(F.col("conn_out") > 0, F.round(F.col("conn_in") / F.col("conn_out"), 2)).otherwise(F.col("conn_in").cast("double"))
    return rows.select("ip", "total_events", (F.col("conn_in") + F.col("conn_out")).alias("connections"), eps.alias("eps"), ratio.alias("in_out_ratio"), "risk_score", S.risk_level(F.col("risk_score")).alias("risk_level"))


def list_assets(cards: DataFrame, text: str = "", kind: str = "", sort: str = "risk_score", number: int = 1, size: int = 50) -> DataFrame:
    """One page of assets whose address, name, type or vendor holds the text."""
    rows = cards
    if text:
        present = [c for c in ("ip", "hostname", "asset_type", "vendor") if c in cards.columns]
        rows = rows.filter(reduce(lambda a, c: a | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False)), present, F.lit(False)))
    if kind:
        rows = rows.filter(F.col("asset_type") == kind)
    return page(rows.orderBy(F.desc(sort), "ip"), number, size)


def _alert_addresses(alerts: DataFrame) -> DataFrame:
    keys = F.array_distinct(F.filter(F.array("src_ip", "asset_id", "dst_ip"), lambda x: x.isNotNull()))
    return alerts.withColumn("ip", F.explode(keys))


def alert_counts_by_ip(alerts: DataFrame) -> DataFrame:
    """Alerts that name an address as source, asset or destination; each once per address."""
    return _alert_addresses(alerts.select("src_ip", "asset_id", "dst_ip")).groupBy("ip").agg(F.count(F.lit(1)).alias("alerts"))


def detections_for_ip(alerts: DataFrame, n: int = 10) -> DataFrame:
    """The latest n alerts of each address."""
    rank = F.row_number().over(Window.partitionBy("ip").orderBy(F.desc("event_time"), F.desc("id")))
    rows = _alert_addresses(alerts.select("id", "event_time", "severity", "src_ip", "asset_id", "dst_ip"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n).select("ip", "rank", "id", "event_time", "severity")


def fleet_analytics(cards: DataFrame) -> DataFrame:
    """Counts by type, risk band and maturity band, coverage of fields in percent (role: a type that is known), mean maturity."""
    kinds = [F.count_if(F.col("asset_type") == k).alias(f"n_{k}") for k in ("workstation", "server", "docker", "iot", "network_device")]
    risks = [F.count_if(F.col("risk_level") == k).alias(f"risk_{k}") for k in ("critical", "high", "medium", "low")]
    cover = [F.round(100.0 * F.count_if(F.coalesce(F.col(c) != "", F.lit(False))) / F.count(F.lit(1)), 1).alias(f"{c}_pct") for c in ("hostname", "vendor", "os_hint", "asset_type")]
    bands = [F.count_if(F.col("maturity_band") == k).alias(f"n_{k}") for k in ("mature", "learning", "sparse")]
    return cards.agg(F.count(F.lit(1)).alias("assets"), *kinds, *risks, *bands, *cover, F.round(F.avg("maturity"), 1).alias("mean_maturity"))


def fleet_top(cards: DataFrame, n: int = 10) -> DataFrame:
    """The busiest assets."""
    return top(cards.select("ip", "eps", "total_events"), n, "eps", "ip")


def fleet_bottom(cards: DataFrame, n: int = 10) -> DataFrame:
    """The assets of which least is known."""
    return cards.select("ip", "maturity").orderBy("maturity", "ip").limit(n)


def fingerprint_coverage(ssl: DataFrame, http: DataFrame, conn: DataFrame) -> DataFrame:
    """Sources with a fingerprint (JA3 or user agent) against those seen in flows alone."""
    named = ssl.filter("ja3 <> ''").select("src_ip").unionByName(http.filter("user_agent <> ''").select("src_ip")).distinct().withColumn("named", F.lit(1))
    every = conn.select("src_ip").unionByName(ssl.select("src_ip")).unionByName(http.select("src_ip")).distinct()
    return every.join(named, "src_ip", "left").agg(F.count(F.lit(1)).alias("assets"), F.count("named").alias("fingerprinted"), (F.count(F.lit(1)) - F.count("named")).alias("flow_only"), F.round(100.0 * F.count("named") / F.count(F.lit(1)), 1).alias("pct"))


# The protocols whose tables count for the coverage.
INSPECTED = ("dns", "http", "ssl", "ssh", "dhcp", "ftp", "smtp", "kerberos", "ntlm", "rdp")
#: Columns that tell an application, by table.
FINGERPRINTS = {"ssl": ("ja3", "ja3s", "server_name"), "http": ("user_agent",)}


def deep_inspection(lake: dict[str, DataFrame]) -> DataFrame:
    """Shares in percent of the inspected protocols that have events (protocol_coverage), of flows (flow_coverage: 100 or 0), and
    their mean (hybrid_coverage), each half to even; assets, those with any fingerprint, and those known from flows alone.
    """
    parts = []
    for name, df in lake.items():
        told = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) != "", F.lit(False)) for c in FINGERPRINTS.get(name, ()) if c in df.columns], F.lit(False))
        parts.append(df.select(F.lit(name).alias("log_type"), F.col("src_ip") if "src_ip" in df.columns else F.lit(None).cast("string").alias("src_ip"), told.alias("told")))
    rows = reduce(DataFrame.unionByName, parts).groupBy("log_type", "src_ip").agg(F.max("told").alias("told"))
    hosts = rows.filter("src_ip IS NOT NULL").groupBy("src_ip").agg(F.max("told").alias("told")).agg(F.count(F.lit(1)).alias("total_assets"), F.count_if("told").alias("fingerprinted"))
    present = rows.groupBy("log_type").agg(F.lit(1).alias("one")).agg(F.count_if(F.col("log_type").isin(*INSPECTED)).alias("n"), F.count_if(F.col("log_type") == "conn").alias("flows"))
    share = F.bround(100.0 * F.col("n") / len(INSPECTED)).cast("int")
    rows = present.select(share.alias("protocol_coverage"), (F.col("flows") * 100).cast("int").alias("flow_coverage")).crossJoin(F.broadcast(hosts))  # one row each
    return rows.select("protocol_coverage", "flow_coverage", F.bround((F.col("protocol_coverage") + F.col("flow_coverage")) / 2).cast("int").alias("hybrid_coverage"), "total_assets", "fingerprinted", (F.col("total_assets") - F.col("fingerprinted")).alias("flow_only"))


def distinct_hosts(conn: DataFrame) -> DataFrame:
    """Number of different addresses on either side."""
    return conn.select(F.col("src_ip").alias("ip")).union(conn.select("dst_ip")).filter("ip IS NOT NULL").distinct().agg(F.count(F.lit(1)).alias("hosts"))
