"""Log analytics: counts, top lists and trends per source. A lake is a dict of log type to DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake.functions import scalars as S
from wirelake.operators.common import in_window, time_column, top, total_bytes, window_ms

# The sources of the dashboards, in their order.
SOURCES = ("conn", "dns", "http", "ssl", "ssh", "ftp", "smtp", "dhcp", "rdp", "smb_files", "smb_mapping", "kerberos", "ntlm", "sip", "snmp", "files", "weird", "notice")
TREND = ("conn", "dns", "http")
FAILED_STATES = ("REJ", "S0", "RSTO", "RSTR")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def tagged(lake: dict[str, DataFrame], *columns: str | Column) -> DataFrame:
    """The given columns of every table with its name as log_type; each scan reads those columns alone."""
    return _union([df.select(F.lit(name).alias("log_type"), *columns) for name, df in lake.items()])


def events_by_type(lake: dict[str, DataFrame]) -> DataFrame:
    return tagged(lake).groupBy("log_type").agg(F.count(F.lit(1)).alias("n"))


def source_counts(lake: dict[str, DataFrame], sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """Every source in its order, missing ones with 0; the total and the number of active ones alongside."""
    spark = next(iter(lake.values())).sparkSession
    listed = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(sources)) + " AS t(place, log_type)")
    counts = listed.join(events_by_type(lake), "log_type", "left").select("place", "log_type", F.coalesce("n", F.lit(0)).alias("n"))
    sums = counts.agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("active"))
    return counts.crossJoin(F.broadcast(sums))  # one row


def event_distribution(lake: dict[str, DataFrame]) -> DataFrame:
    return events_by_type(lake).filter("n > 0").orderBy(F.desc("n"), "log_type")


def protocol_distribution(conn: DataFrame, n: int = 10) -> DataFrame:
    """Grouped as they are, lower-cased after."""
    out = conn.groupBy(F.coalesce("protocol", F.lit("unknown")).alias("protocol")).agg(F.count(F.lit(1)).alias("n"))
    return top(out, n, "n", "protocol").select(F.lower("protocol").alias("protocol"), "n")


def top_values(df: DataFrame, column: str, n: int = 10, skip: tuple[str, ...] = ()) -> DataFrame:
    """The most common values; nulls and those to skip don't count."""
    kept = df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*skip)) if skip else df.filter(F.col(column).isNotNull())
    return top(kept.groupBy(F.col(column).cast("string").alias(column)).agg(F.count(F.lit(1)).alias("n")), n, "n", column)


def top_sources(conn: DataFrame, n: int = 10) -> DataFrame:
    return top_values(conn, "src_ip", n)


def top_destinations(conn: DataFrame, n: int = 10) -> DataFrame:
    return top_values(conn, "dst_ip", n)


def top_dns_queries(dns: DataFrame, n: int = 10) -> DataFrame:
    return top_values(dns, "query", n, ("", "-"))


def top_http_hosts(http: DataFrame, n: int = 10) -> DataFrame:
    return top_values(http, "host", n, ("", "-"))


def top_status_codes(http: DataFrame, n: int = 10) -> DataFrame:
    return top_values(http, "status_code", n)


def _hours(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))


def hourly_trend(lake: dict[str, DataFrame]) -> DataFrame:
    """24 hours of the day, zero filled."""
    rows = tagged({k: v for k, v in lake.items() if k in TREND}, "event_time")
    counts = rows.groupBy(S.hour_of(F.col("event_time")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return _hours(rows).join(F.broadcast(counts), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def source_trend(lake: dict[str, DataFrame]) -> DataFrame:
    """24 hours of the day by source."""
    rows = tagged({k: v for k, v in lake.items() if k in TREND}, "event_time")
    counts = rows.groupBy(S.hour_of(F.col("event_time")).alias("hour")).pivot("log_type", list(TREND)).agg(F.count(F.lit(1)))
    return _hours(rows).join(F.broadcast(counts), "hour", "left").select("hour", *(F.coalesce(t, F.lit(0)).alias(t) for t in TREND))


def alert_trend(conn: DataFrame, dns: DataFrame, http: DataFrame) -> DataFrame:
    """Hours of failed connections, unknown names and HTTP errors."""
    rows = _union([
        conn.filter(F.col("conn_state").isin(*FAILED_STATES)).select("event_time"),
        dns.filter(F.col("rcode_name") == "NXDOMAIN").select("event_time"),
        http.filter(F.col("status_code") >= 400).select("event_time"),
    ])
    counts = rows.groupBy(S.hour_of(F.col("event_time")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return _hours(rows).join(F.broadcast(counts), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def daily_trend(lake: dict[str, DataFrame], now_ms: int, days: int = 30) -> DataFrame:
    """Events of each day (days since 1970) that has some, up to so many days back."""
    rows = tagged({k: in_window(v, "30d", now_ms) for k, v in lake.items() if k in TREND}, "event_time")
    return rows.groupBy(S.day_of(F.col("event_time")).alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("day")).limit(days)


def ingest_rate(lake: dict[str, DataFrame], window: str, now_ms: int) -> DataFrame:
    """Events a second over the window, four decimals; all time counts as 30 days."""
    seconds = (window_ms(window) or window_ms("30d")) / 1000
    total = tagged({k: in_window(v, window, now_ms) for k, v in lake.items()}).agg(F.count(F.lit(1)).alias("total"))
    return total.select("total", F.round(F.col("total") / seconds, 4).alias("rate"))


def traffic_by_hour(conn: DataFrame) -> DataFrame:
    """Megabytes in both directions per hour of the day, two decimals."""
    out = conn.groupBy(S.hour_of(F.col("event_time")).alias("hour")).agg(F.sum(total_bytes()).alias("bytes"))
    return out.select("hour", "bytes", F.round(F.col("bytes") / 1_000_000, 2).alias("mb"))


def protocol_share(conn: DataFrame, n: int = 10) -> DataFrame:
    """The most common protocols and their part of those shown, in percent."""
    shown = protocol_distribution(conn, n)
    total = shown.agg(F.sum("n").alias("total"))
    return shown.crossJoin(F.broadcast(total)).select("protocol", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))  # one row


def latency(rows: DataFrame) -> DataFrame:
    """Events per log type and bucket of ingest_time - event_time (-1: beyond the last bound)."""
    return rows.groupBy("log_type", S.latency_bucket(F.col("ingest_time") - F.col("event_time")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def overview(alerts: DataFrame, lake: dict[str, DataFrame], tables: int = 10) -> DataFrame:
    """Alerts by severity, assets, and health by the share of tables that hold rows."""
    severities = alerts.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")), F.count_distinct("asset_id").alias("assets"))
    present = events_by_type(lake).agg(F.count_if(F.col("n") > 0).alias("present"))
    share = 100.0 * F.col("present") / tables
    health = F.when(share >= 60, "healthy").when(share >= 30, "degraded").otherwise("critical")
    return severities.crossJoin(F.broadcast(present)).select("critical", "high", "medium", "low", "assets", "present", health.alias("health"))  # one row each


def analytics_bundle(conn: DataFrame, n: int = 10) -> DataFrame:
    """All top lists and trends of connections in one pass: (widget, value, n), the first n of each list."""
    rows = conn.select(
        F.coalesce("protocol", F.lit("unknown")).alias("protocol"), "src_ip", "dst_ip",
        S.hour_of(F.col("event_time")).cast("string").alias("hour"), S.day_of(F.col("event_time")).cast("string").alias("day"),
    )
    sets = conn.sparkSession.sql("""
        SELECT CASE grouping_id() WHEN 15 THEN 'protocol' WHEN 23 THEN 'src_ip' WHEN 27 THEN 'dst_ip' WHEN 29 THEN 'hour' ELSE 'day' END AS widget,
               coalesce(protocol, src_ip, dst_ip, hour, day) AS value, count(*) AS n
        FROM {rows} GROUP BY protocol, src_ip, dst_ip, hour, day GROUPING SETS ((protocol), (src_ip), (dst_ip), (hour), (day))
    """, rows=rows)  # fmt: skip
    rank = F.row_number().over(Window.partitionBy("widget").orderBy(F.desc("n"), "value"))
    return sets.filter(F.col("value").isNotNull()).withColumn("rank", rank).filter((F.col("rank") <= n) | F.col("widget").isin("hour", "day")).drop("rank")


#: The top lists of each source's dashboard and the values that they leave out.
LISTS: dict[str, dict[str, tuple[str, ...]]] = {
    "conn": {"protocol": (), "src_ip": (), "dst_ip": ()},
    "dns": {"query": ("", "-")},
    "http": {"host": ("", "-"), "status_code": ()},
}


def _alerting(name: str) -> Column | None:
    """Whether an event of a source counts for the alert trend."""
    if name == "conn":
        return F.col("conn_state").isin(*FAILED_STATES)
    if name == "dns":
        return F.col("rcode_name") == "NXDOMAIN"
    return F.col("status_code") >= 400 if name == "http" else None


def millis(column: str) -> Column:
    """A time column in milliseconds; as in in_window, small numbers are seconds."""
    return F.when(F.col(column) <= 1_000_000_000_000, F.col(column) * 1000).otherwise(F.col(column))


def widgets(name: str) -> dict[str, Column]:
    """The values that a source's dashboard counts, by widget: its top lists, hours, days, hours of alerts, and all events."""
    out = {}
    for column, skip in LISTS.get(name, {}).items():
        value = F.coalesce(F.col(column), F.lit("unknown")) if column == "protocol" else F.col(column).cast("string")
        out[column] = F.when(~value.isin(*skip), value) if skip else value
    hour = S.hour_of(millis("event_time")).cast("string")
    out |= {"hour": hour, "day": S.day_of(millis("event_time")).cast("string")}
    if (alerting := _alerting(name)) is not None:
        out["alert_hour"] = F.when(alerting, hour)
    return out | {"events": F.lit("all")}


#: Widgets that are no top lists.
WHOLE = ("hour", "day", "alert_hour", "events")


def counted_widgets(name: str, rows: DataFrame, key: Column, label: str) -> DataFrame:
    """log_type, the key by its label, widget, value, n: one pass over rows by grouping sets."""
    values = widgets(name)
    rows = rows.select(key.alias(label), *(v.alias(c) for c, v in values.items()))
    sets = rows.groupingSets([[label, F.col(c)] for c in values], label, *values).agg(F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n"))
    # the bit of the one value that a set groups by is 0
    every = (1 << len(values)) - 1
    widget = F.coalesce(*(F.when(F.col("_set") == every - (1 << (len(values) - 1 - i)), c) for i, c in enumerate(values)))
    return sets.select(F.lit(name).alias("log_type"), label, widget.alias("widget"), F.coalesce(*values).alias("value"), "n").filter(F.col("value").isNotNull())


def ranked_widgets(counts: DataFrame, n: int) -> DataFrame:
    """The first n of each top list, and all of the rest. counts: log_type, window, widget, value, n."""
    rank = F.row_number().over(Window.partitionBy("log_type", "window", "widget").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).filter((F.col("rank") <= n) | F.col("widget").isin(*WHOLE)).drop("rank")


def ingest_rates(bundle: DataFrame) -> DataFrame:
    """Events a second of each source and window of a bundle, four decimals; all time counts as 30 days."""
    seconds = F.lit(window_ms("30d") / 1000)
    for label in ("1h", "6h", "24h", "7d"):
        seconds = F.when(F.col("window") == label, window_ms(label) / 1000).otherwise(seconds)
    return bundle.filter("widget = 'events'").select("log_type", "window", F.col("n").alias("total"), F.round(F.col("n") / seconds, 4).alias("rate"))


def lake_bundle(lake: dict[str, DataFrame], windows: tuple[str, ...], now_ms: int, n: int = 10) -> DataFrame:
    """All top lists and trends of every source and window: (log_type, window, widget, value, n).

    Each table is read once. An event is counted for the narrowest window it lies in; as the windows lie within
    one another, a wider one adds up the counts of those inside it. Windows go by ingest time, where a table has it; small times
    are seconds.
    """
    lengths = sorted(((window_ms(w), w) for w in windows), key=lambda x: (x[0] is None, x[0] or 0))
    inside = F.array(*(F.lit(w) for _, w in lengths))
    parts = []
    for name, df in lake.items():
        age = F.lit(now_ms) - millis(time_column(df))
        narrowest = F.coalesce(*(F.when(age <= length if length is not None else F.lit(True), i) for i, (length, _) in enumerate(lengths)))
        parts.append(counted_widgets(name, in_window(df, lengths[-1][1], now_ms), narrowest, "narrowest"))
    counts = _union(parts).withColumn("window", F.explode(F.slice(inside, F.col("narrowest") + 1, len(lengths))))
    return ranked_widgets(counts.groupBy("log_type", "window", "widget", "value").agg(F.sum("n").alias("n")), n)


def write_bundle(bundle: DataFrame, path: str) -> None:
    """The bundle as Parquet by window and log type, for dashboards that read one of them."""
    bundle.repartition("window", "log_type").sortWithinPartitions("widget", F.desc("n"), "value").write.mode("overwrite").partitionBy("window", "log_type").parquet(path)
