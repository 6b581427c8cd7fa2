"""Search over all tables and threat hunts over one or several."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake import refdata
from wirelake.functions.scalars import escape_like
from wirelake.operators.common import in_window, page, top, total_bytes

# The columns that free text is looked for in.
TEXT_COLUMNS = ("flow_id", "src_ip", "dst_ip", "protocol", "service", "query", "host", "uri", "user_agent", "method", "server_name", "host_name", "note", "msg")
#: Words that a hunt in SQL must not hold.
FORBIDDEN = ("insert", "update", "delete", "drop", "alter", "create", "truncate", "attach", "detach", "copy", "pragma", "install", "load")
_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
LIMIT = 200

Condition = tuple[str, str, object]  # field, operator, value


def _like(c: Column, value: object, before: str, after: str, raw: bool, fold: bool) -> Column:
    text = str(value) if raw else escape_like(str(value))
    return c.ilike(before + text + after) if fold else c.like(before + text + after)


def search_condition(df: DataFrame, condition: Condition, raw_like: bool = False) -> Column | None:
    """On the text form, whatever the type: > is by characters; contains, starts, ends ignore case.

    None for a field that the table lacks; an unsafe name is refused.
    """
    name, op, value = condition
    if not _NAME.match(name):
        raise ValueError(f"not a field name: {name!r}")
    if name not in df.columns:
        return None
    c, v = F.col(name).cast("string"), F.lit(str(value))
    simple = {"==": c == v, "!=": c != v, ">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v}
    if op in simple:
        return simple[op]
    before, after = {"contains": ("%", "%"), "starts": ("", "%"), "ends": ("%", "")}[op]
    return _like(c, value, before, after, raw_like, True)


def hunt_condition(condition: Condition, raw_like: bool = False) -> Column:
    """By type: a value that reads as a number is one, else text; LIKE heeds case."""
    name, op, value = condition
    if not _NAME.match(name):
        raise ValueError(f"not a field name: {name!r}")
    op = {"EQUAL": "==", "EQUALS": "==", "=": "==", "NOT_EQUAL": "!=", "NOT_EQUALS": "!=", "GREATER": ">", "GREATER_THAN": ">", "LESS": "<", "LESS_THAN": "<"}.get(op.upper(), op.upper())
    c = F.col(name)
    if op == "CONTAINS":
        return _like(c, value, "%", "%", raw_like, False)
    if op == "STARTS_WITH":
        return _like(c, value, "", "%", raw_like, False)
    try:
        v = F.lit(int(str(value)) if re.fullmatch(r"[+-]?\d+", str(value)) else float(str(value)))
    except ValueError:
        v = F.lit(str(value))
    return {"==": c == v, "!=": c != v, ">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v}[op]


def _matching(df: DataFrame, text: str, conditions: list[Condition], raw_like: bool) -> DataFrame:
    if text:
        present = [c for c in TEXT_COLUMNS if c in df.columns]
        df = df.filter(reduce(lambda a, c: a | _like(F.col(c).cast("string"), text, "%", "%", raw_like, True), present, F.lit(False)))
    for condition in conditions:
        if (found := search_condition(df, condition, raw_like)) is not None:
            df = df.filter(found)
    return df


def search(lake: dict[str, DataFrame], now_ms: int, text: str = "", conditions: tuple[Condition, ...] = (), source: str = "all", window: str = "all", number: int = 1, size: int = 50, raw_like: bool = False) -> DataFrame:
    """One page over the tables, newest first, then by flow_id; _source names the table.

    Each table gives its newest rows up to the page's end before they meet, so nothing is sorted whole.
    """
    parts = []
    for name, df in lake.items():
        if source in ("all", name):
            rows = _matching(in_window(df, window, now_ms), text, list(conditions), raw_like)
            rows = rows.orderBy(F.desc("event_time"), "flow_id").limit(number * size)
            parts.append(rows.select(F.lit(name).alias("_source"), *df.columns))
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return page(found.orderBy(F.desc("event_time"), "flow_id", "_source"), number, size)


def search_total(lake: dict[str, DataFrame], text: str = "", conditions: tuple[Condition, ...] = (), raw_like: bool = False) -> DataFrame:
    """The exact number of matches by table."""
    parts = [_matching(df, text, list(conditions), raw_like).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("_source"), "n") for name, df in lake.items()]
    return reduce(DataFrame.unionByName, parts)


def hunt_rows(df: DataFrame, *conditions: Condition, limit: int = LIMIT) -> DataFrame:
    """Rows that meet all conditions, the first by flow_id."""
    return reduce(lambda d, c: d.filter(hunt_condition(c)), conditions, df).orderBy("flow_id").limit(limit)


def hunt_grouped(df: DataFrame, keys: list[str], least: int, *conditions: Condition, limit: int = LIMIT) -> DataFrame:
    """Groups of at least so many rows, largest first."""
    rows = reduce(lambda d, c: d.filter(hunt_condition(c)), conditions, df)
    return top(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least), limit, "n", *keys)


def read_only(statement: str) -> str:
    """The statement if it only reads; else an error."""
    words = re.findall(r"[a-z_]+", statement.lower())
    if not words or words[0] not in ("select", "with", "explain", "describe", "show") or any(w in FORBIDDEN for w in words) or ";" in statement.strip().rstrip(";"):
        raise ValueError("only a single reading statement is allowed")
    return statement.strip().rstrip(";")


def hunt_sql(lake: dict[str, DataFrame], statement: str) -> DataFrame:
    """An analyst's statement over the tables, each named in braces or plainly as a view."""
    statement = read_only(statement)
    spark = next(iter(lake.values())).sparkSession
    for name, df in lake.items():
        df.createOrReplaceTempView(name)
    return spark.sql(statement)


def hunt_result(rows: DataFrame, name: str, reasoning: str) -> DataFrame:
    """One record: what was hunted, why, the number of matches and the rows as JSON (LIMIT rows at most)."""
    rows = rows.orderBy(*(c for c, kind in rows.dtypes if not kind.startswith(("map", "variant")))).limit(LIMIT)
    return rows.agg(F.lit(name).alias("detection"), F.lit(reasoning).alias("reasoning"), F.count(F.lit(1)).alias("matches"), F.to_json(F.array_sort(F.collect_list(F.to_json(F.struct(*rows.columns))))).alias("evidence"))


def lookup_uid(lake: dict[str, DataFrame], uid: str) -> DataFrame:
    """The first row with this flow id by time in any table, tables in their order."""
    parts = [df.filter(F.col("flow_id") == uid).orderBy("event_time").limit(1).select(F.lit(i).alias("_place"), F.lit(name).alias("_source"), *df.columns) for i, (name, df) in enumerate(lake.items())]
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return found.orderBy("_place").limit(1).drop("_place")


# --- saved hunts -------------------------------------------------------------------------------------


def long_dns_queries(dns: DataFrame, longer_than: int = 50, n: int = 20) -> DataFrame:
    rows = dns.filter(F.length("query") > longer_than).select("flow_id", "src_ip", "query", F.length("query").alias("length"))
    return top(rows, n, "length", "flow_id")


def large_senders(conn: DataFrame, least: int = 10_000_000) -> DataFrame:
    return conn.groupBy("src_ip").agg(F.sum("orig_bytes").alias("sent")).filter(F.col("sent") > least)


def ssh_pairs(conn: DataFrame, n: int = 20) -> DataFrame:
    out = conn.filter("dst_port = 22").groupBy("src_ip", "dst_ip", "dst_port").agg(F.count(F.lit(1)).alias("n"), F.sum(total_bytes()).alias("bytes"), F.round(F.avg("duration"), 4).alias("mean_duration"))
    return top(out.filter("n > 1"), n, "n", "src_ip", "dst_ip")


def top_talkers(conn: DataFrame, n: int = 10) -> DataFrame:
    return top(conn.groupBy("src_ip").agg(F.sum(total_bytes()).alias("bytes"), F.count(F.lit(1)).alias("connections")), n, "bytes", "src_ip")


def powershell_exe_downloads(http: DataFrame) -> DataFrame:
    return http.filter(F.col("user_agent").like("%PowerShell%") & F.col("uri").like("%.exe")).select("flow_id", "src_ip", "dst_ip", "uri", "user_agent")


def icmp_tunnel(conn: DataFrame, least: int = 1000) -> DataFrame:
    return conn.filter((F.col("protocol") == "icmp") & (F.col("orig_bytes") > least)).select("flow_id", "src_ip", "dst_ip", "orig_bytes")


def rogue_dhcp(conn: DataFrame, servers: DataFrame | None = None) -> DataFrame:
    """Sources of DHCP server traffic that are not on the list."""
    servers = servers if servers is not None else F.broadcast(refdata.frame(conn.sparkSession, refdata.DHCP_SERVERS, "server string"))
    return conn.filter("dst_port = 67").join(servers, F.col("src_ip") == F.col("server"), "left_anti").select("flow_id", "src_ip", "dst_ip")


def dns_http_conn(dns: DataFrame, http: DataFrame, conn: DataFrame, n: int = 50) -> DataFrame:
    """Name lookups, requests and connections of one source (connection to the request's destination).

    Only the first rows by (source, lookup time, ids) are asked for. Their number is known per source and
    lookup from counts, without joining, so only the few lookups that hold them are joined.
    """
    by_dns = dns.groupBy("src_ip").agg(F.count(F.lit(1)).alias("d"))
    by_http = http.groupBy("src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("h"))
    by_conn = conn.groupBy("src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("c"))
    joined = by_http.join(by_conn, ["src_ip", "dst_ip"]).groupBy("src_ip").agg(F.sum(F.col("h") * F.col("c")).alias("joined"))
    first = joined.join(by_dns, "src_ip").select("src_ip", "joined").orderBy("src_ip").limit(n)  # each source holds one row at least
    d = dns.join(F.broadcast(first), "src_ip").select("src_ip", F.col("flow_id").alias("dns_id"), "event_time", "query", "joined")
    d = d.orderBy("src_ip", "event_time", "dns_id").limit(n)  # and so does each of their lookups
    before = F.sum("joined").over(Window.orderBy("src_ip", "event_time", "dns_id").rowsBetween(Window.unboundedPreceding, -1))  # n rows at most
    d = d.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < n).drop("joined", "before")
    # of a lookup's rows only the first n are asked for: so only the first n requests that have connections, and n connections of each pair
    sources = F.broadcast(d.select("src_ip").distinct())
    met = conn.join(sources, "src_ip", "left_semi").select("src_ip", "dst_ip").distinct()
    h = http.join(sources, "src_ip", "left_semi").join(met, ["src_ip", "dst_ip"], "left_semi").select("src_ip", "dst_ip", F.col("flow_id").alias("http_id"), "host")
    h = h.withColumn("_rank", F.row_number().over(Window.partitionBy("src_ip").orderBy("http_id", "dst_ip"))).filter(F.col("_rank") <= n).drop("_rank")
    c = conn.join(sources, "src_ip", "left_semi").select("src_ip", "dst_ip", F.col("flow_id").alias("conn_id"), "orig_bytes")
    c = c.withColumn("_rank", F.row_number().over(Window.partitionBy("src_ip", "dst_ip").orderBy("conn_id"))).filter(F.col("_rank") <= n).drop("_rank")
    out = F.broadcast(d).join(h, "src_ip").join(c, ["src_ip", "dst_ip"])
    return out.select("src_ip", "dst_ip", "event_time", "dns_id", "http_id", "conn_id", "query", "host", "orig_bytes").orderBy("src_ip", "event_time", "dns_id", "http_id", "conn_id").limit(n)


def dns_http_conn_near(dns: DataFrame, http: DataFrame, conn: DataFrame, within_ms: int = 60_000) -> DataFrame:
    """The bounded form for whole tables: lookup and request within so much time, connections as pair totals.

    The time goes into buckets, so the join is by equality; a request meets its bucket and the two beside it.
    """
    bucket = F.floor(F.col("event_time") / within_ms).cast("long")
    d = dns.select("src_ip", F.col("flow_id").alias("dns_id"), F.col("event_time").alias("dns_time"), "query", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    h = http.select("src_ip", "dst_ip", F.col("flow_id").alias("http_id"), F.col("event_time").alias("http_time"), bucket.alias("bucket"))
    pairs = conn.groupBy("src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("connections"), F.sum(total_bytes()).alias("bytes"))
    near = d.join(h, ["src_ip", "bucket"]).filter(F.abs(F.col("dns_time") - F.col("http_time")) <= within_ms)
    return near.join(pairs, ["src_ip", "dst_ip"]).select("src_ip", "dst_ip", "dns_id", "http_id", "query", "connections", "bytes")


def rare_dns_types(dns: DataFrame, n: int = 10) -> DataFrame:
    return dns.groupBy("qtype_name").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "qtype_name").limit(n)


def http_error_counts(http: DataFrame) -> DataFrame:
    return http.filter("status_code >= 400").groupBy("status_code").agg(F.count(F.lit(1)).alias("n"))


def longest_connections(conn: DataFrame, n: int = 10) -> DataFrame:
    return top(conn.select("flow_id", "src_ip", "dst_ip", "duration"), n, "duration", "flow_id")


def domains_for_ip(dns: DataFrame, ip: str) -> DataFrame:
    return dns.filter(F.col("dst_ip") == ip).groupBy("query").agg(F.count(F.lit(1)).alias("n"))


def cleartext_passwords(http: DataFrame) -> DataFrame:
    return http.filter("method = 'POST' AND password IS NOT NULL AND password <> ''").select("flow_id", "src_ip", "dst_ip", "host")


def unusual_ports(conn: DataFrame, n: int = 100) -> DataFrame:
    out = conn.filter(~F.col("dst_port").isin(53, 80, 443, 22)).groupBy("dst_ip", "dst_port").agg(F.count(F.lit(1)).alias("n"))
    return top(out, n, "n", "dst_ip", "dst_port")


def failed_connections(conn: DataFrame, n: int = 100) -> DataFrame:
    out = conn.filter(F.col("conn_state").isin("REJ", "S0", "RSTO", "RSTR")).groupBy("src_ip", "dst_ip", "conn_state").agg(F.count(F.lit(1)).alias("n"))
    return top(out, n, "n", "src_ip", "dst_ip", "conn_state")


def large_transfers(conn: DataFrame, n: int = 50) -> DataFrame:
    out = conn.groupBy("src_ip", "dst_ip").agg(F.sum(total_bytes()).alias("bytes"))
    return top(out, n, "bytes", "src_ip", "dst_ip")
