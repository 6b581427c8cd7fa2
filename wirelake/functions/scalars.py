"""Column functions of the enrichment: addresses, ports, times, labels. No UDF, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelake import refdata

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
#: An IPv4 address or one mapped into IPv6, in 10/8, 172.16/12 or 192.168/16.
PRIVATE = rf"^(::[fF]{{4}}:)?(10\.{_OCTET}\.{_OCTET}\.{_OCTET}|172\.(1[6-9]|2[0-9]|3[01])\.{_OCTET}\.{_OCTET}|192\.168\.{_OCTET}\.{_OCTET})$"
TRACKABLE = PRIVATE.replace("(::[fF]{4}:)?", "")
#: Address patterns that the dashboards take for internal; they differ from PRIVATE on purpose.
INTERNAL_LIKE = ("10.%", "192.168.%", "172.16.%", "172.17.%", "172.18.%", "172.19.%", "172.2%.%", "172.30.%", "172.31.%", "127.0.0.1")


def is_private_ip(ip: Column) -> Column:
    """IPv4 in a private block; IPv6, invalid, empty and null are false."""
    return F.coalesce(ip.rlike(PRIVATE), F.lit(False))


def is_trackable_ip(ip: Column) -> Column:
    """A private unicast IPv4 address, white space round it aside."""
    return F.coalesce(F.trim(ip).rlike(TRACKABLE), F.lit(False))


def ipv4_number(ip: Column) -> Column:
    """The address as a long; null unless it is a strict IPv4 address."""
    part = F.split(ip, r"\.")
    number = reduce(lambda a, i: a * 256 + F.get(part, F.lit(i)).try_cast("long"), range(1, 4), F.get(part, F.lit(0)).try_cast("long"))
    return F.when(ip.rlike(IPV4), number)


def direction(src: Column, dst: Column) -> Column:
    """outbound, inbound, internal or external; empty unless both addresses are there."""
    return direction_of(src, dst, is_private_ip(src), is_private_ip(dst))


def direction_of(src: Column, dst: Column, src_private: Column, dst_private: Column) -> Column:
    """The same where it is known already which address is private."""
    return (
        F.when((F.coalesce(src, F.lit("")) == "") | (F.coalesce(dst, F.lit("")) == ""), "")
        .when(src_private & dst_private, "internal").when(src_private, "outbound").when(dst_private, "inbound").otherwise("external")
    )


def is_external_like(dst: Column) -> Column:
    """Not like any internal pattern; null stays null."""
    return ~reduce(lambda a, p: a | dst.like(p), INTERNAL_LIKE[1:], dst.like(INTERNAL_LIKE[0]))


def port_to_service(port: Column) -> Column:
    return F.coalesce(reduce(lambda a, x: a.when(port == x[0], x[1]), list(refdata.PORT_SERVICES.items())[1:], F.when(port == 53, "dns")), F.lit("unknown"))


def service_from(port: Column, protocol: Column) -> Column:
    """By port where there is one, else the protocol, else empty."""
    return F.when(port > 0, port_to_service(port)).otherwise(F.coalesce(protocol, F.lit("")))


def is_local_mac(mac: Column) -> Column:
    """The locally administered bit of the first octet; invalid ones are false."""
    first = F.substring(mac, 1, 2)
    return F.coalesce(first.rlike("^[0-9A-Fa-f]{2}$") & (F.conv(first, 16, 10).try_cast("int").bitwiseAND(F.lit(2)) > 0), F.lit(False))


def os_from_user_agent(agent: Column) -> Column:
    """The first rule that fits, whatever the case; Android agents name Linux first."""
    a = F.lower(agent)
    # Part of the agent, system; in this order.
    rules = (("windows nt 10", "Windows 10/11"), ("windows nt 6.3", "Windows 8.1"), ("windows nt 6.1", "Windows 7"), ("mac os x", "macOS"), ("linux", "Linux"), ("android", "Android"), ("iphone", "iOS"), ("ipad", "iOS"))
    return F.coalesce(F.coalesce(*(F.when(F.contains(a, F.lit(part)), name) for part, name in rules)), F.lit(""))


def event_ms(value: Column) -> Column:
    """Epoch milliseconds of a time as text: seconds as a number (cut toward zero), or RFC 3339; else 0."""
    text = F.trim(value)
    number = (text.try_cast("double") * 1000).try_cast("long")
    return F.coalesce(number, F.unix_millis(F.try_to_timestamp(text)), F.lit(0).cast("long"))


def ingest_ts(value: Column) -> Column:
    """A timestamp of mixed notations: text, or epoch ms (over 1e12) or seconds; else null."""
    number = value.try_cast("bigint")
    by_number = F.when(number > 1_000_000_000_000, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number))
    return F.when(number.isNotNull(), by_number).otherwise(F.try_to_timestamp(value.cast("string")))


def parse_alert_time(value: Column) -> Column:
    """A timestamp of ISO text, with Z or an offset, or of SQL text with or without a fraction; else null."""
    return F.try_to_timestamp(F.trim(value))


def parse_any_time(value: Column) -> Column:
    """The same, or of a number as text: epoch milliseconds from 1e12 on, else seconds with their fraction."""
    number = F.when(F.trim(value).rlike(r"^[0-9]+(\.[0-9]+)?$"), F.trim(value).try_cast("double"))
    return F.when(number.isNotNull(), F.timestamp_millis(F.when(number >= 1e12, number).otherwise(number * 1000).cast("long"))).otherwise(parse_alert_time(value))


# Upper bounds of the latency histogram in ms.
LATENCY_MS = (10, 50, 100, 500, 1000, 5000)


def latency_bucket(ms: Column) -> Column:
    """The smallest bound that holds the latency; -1 beyond the last, null for null."""
    out = F.when(ms.isNotNull(), F.lit(-1))
    for bound in reversed(LATENCY_MS):
        out = F.when(ms <= bound, bound).otherwise(out)
    return out


def time_parts(ms: Column) -> dict[str, Column]:
    """year, month, day, hour, weekday (0 is Sunday) in UTC; all 0 unless the time is over 0."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int"))
    zero = lambda c: F.when(ms > 0, c.cast("int")).otherwise(0)
    return {"event_year": zero(F.year(day)), "event_month": zero(F.month(day)), "event_day": zero(F.dayofmonth(day)), "event_hour": zero(hour_of(ms)), "event_weekday": zero(F.dayofweek(day) - 1)}


def hour_of(ms: Column) -> Column:
    """Hour of the day in UTC."""
    return F.pmod(F.floor(ms / 3_600_000), F.lit(24)).cast("int")


def day_of(ms: Column) -> Column:
    """Days since 1970-01-01 in UTC."""
    return F.floor(ms / 86_400_000).cast("long")


def format_bytes(n: Column, terabytes: bool = False) -> Column:
    """One decimal in powers of 1000, ties up; whole bytes below the first."""
    steps = [(1e3, "KB"), (1e6, "MB"), (1e9, "GB")] + ([(1e12, "TB")] if terabytes else [])
    n = F.coalesce(n, F.lit(0))
    out = F.format_string("%d B", n)
    for size, unit in steps:
        out = F.when(n >= size, F.format_string(f"%.1f {unit}", n / size)).otherwise(out)
    return out


def risk_level(score: Column) -> Column:
    return F.when(score >= 70, "critical").when(score >= 50, "high").when(score >= 30, "medium").otherwise("low")


def risk_severity(points: Column) -> Column:
    return F.when(points >= 150, "critical").when(points >= 100, "high").when(points >= 60, "medium").otherwise("low")


def age_label(ms: Column, now_ms: int) -> Column:
    """How long before now, in the largest whole unit."""
    s = F.greatest(F.lit(0), F.floor((F.lit(now_ms) - ms) / 1000)).cast("long")
    unit = lambda size, name: F.concat(F.floor(s / size).cast("string"), F.lit(f"{name} ago"))
    return F.when(ms.isNull(), "unknown").when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def iso_time(ms: Column) -> Column:
    """RFC 3339 to the second, UTC; empty for 0 or null."""
    return F.when(F.coalesce(ms, F.lit(0)) > 0, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("")


def lenient_long(value: Column) -> Column:
    """The whole number that a text holds; anything else is 0."""
    return F.coalesce(F.when(value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("long")), F.lit(0).cast("long"))


def finite_or_null(value: Column) -> Column:
    return F.when(F.isnan(value) | value.isin(float("inf"), float("-inf")), None).otherwise(value)


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
