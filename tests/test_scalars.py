"""Table-driven cases of the scalar functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wirelake.functions import scalars as S


def _one(spark, fn, *values):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'long'}" for n, v in zip(names, values))
    return spark.createDataFrame([tuple(values)], schema).select(fn(*(F.col(n) for n in names)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("ip", "expected"),
    [("10.0.0.1", True), ("10.255.255.255", True), ("172.16.0.1", True), ("172.31.255.255", True), ("172.15.0.1", False), ("172.32.0.1", False), ("192.168.1.1", True), ("192.169.0.1", False), ("8.8.8.8", False), ("", False), ("bad", False), ("fe80::1", False), ("::ffff:10.0.0.1", True), ("010.0.0.1", False), ("10.0.0.256", False), (None, False)],
)
def test_private_ip(spark, ip, expected):
    assert _one(spark, S.is_private_ip, ip) is expected


@pytest.mark.parametrize(("ip", "expected"), [(" 10.0.0.1 ", True), ("192.168.0.9", True), ("127.0.0.1", False), ("224.0.0.1", False), ("169.254.1.1", False), ("255.255.255.255", False), ("0.0.0.0", False), ("8.8.8.8", False), ("", False), ("::ffff:10.0.0.1", False)])
def test_trackable_ip(spark, ip, expected):
    assert _one(spark, S.is_trackable_ip, ip) is expected


@pytest.mark.parametrize(("a", "b", "expected"), [("10.0.0.1", "8.8.8.8", "outbound"), ("8.8.8.8", "10.0.0.1", "inbound"), ("10.0.0.1", "192.168.0.1", "internal"), ("8.8.8.8", "1.1.1.1", "external"), ("", "1.1.1.1", ""), (None, "1.1.1.1", "")])
def test_direction(spark, a, b, expected):
    assert _one(spark, S.direction, a, b) == expected


@pytest.mark.parametrize(("port", "expected"), [(53, "dns"), (80, "http"), (443, "https"), (22, "ssh"), (25, "smtp"), (587, "smtp"), (3389, "rdp"), (8080, "http-proxy"), (12345, "unknown"), (0, "unknown")])
def test_port_service(spark, port, expected):
    assert _one(spark, S.port_to_service, port) == expected


@pytest.mark.parametrize(("port", "protocol", "expected"), [(443, "tcp", "https"), (0, "udp", "udp"), (0, "", ""), (0, "icmp", "icmp")])
def test_service_from(spark, port, protocol, expected):
    assert _one(spark, S.service_from, port, protocol) == expected


@pytest.mark.parametrize(("mac", "expected"), [("02:00:00:00:00:01", True), ("06:11:22:33:44:55", True), ("0A:00:00:00:00:00", True), ("0E:00:00:00:00:00", True), ("00:50:56:00:00:01", False), ("18:B4:30:00:00:00", False), ("zz:00", False), ("", False), ("f2:00:00:00:00:00", True)])
def test_local_mac(spark, mac, expected):
    assert _one(spark, S.is_local_mac, mac) is expected


@pytest.mark.parametrize(("agent", "expected"), [("Mozilla/5.0 (Windows NT 10.0)", "Windows 10/11"), ("Windows NT 6.1", "Windows 7"), ("Intel Mac OS X", "macOS"), ("Linux; Android 13", "Linux"), ("iPhone", "iOS"), ("curl/8", "")])
def test_os(spark, agent, expected):
    assert _one(spark, S.os_from_user_agent, agent) == expected


@pytest.mark.parametrize(("text", "expected"), [("1700000000.123", 1700000000123), (" 1700000000 ", 1700000000000), ("2023-11-14T22:13:20Z", 1700000000000), ("2023-11-15T00:13:20+02:00", 1700000000000), ("x", 0), (None, 0)])
def test_event_ms(spark, text, expected):
    assert _one(spark, S.event_ms, text) == expected


@pytest.mark.parametrize(("text", "expected"), [("12", 12), ("-3", -3), ("1.5", 0), ("", 0), (None, 0), ("abc", 0)])
def test_lenient(spark, text, expected):
    assert _one(spark, S.lenient_long, text) == expected


def test_time_parts(spark):
    row = spark.createDataFrame([(1700000000123,), (0,)], "ms long").select(*(c.alias(n) for n, c in S.time_parts(F.col("ms")).items())).collect()
    assert tuple(row[0]) == (2023, 11, 14, 22, 2)
    assert tuple(row[1]) == (0, 0, 0, 0, 0)


@pytest.mark.parametrize(("ms", "expected"), [(5_000, "5s ago"), (65_000, "1m ago"), (7_200_000, "2h ago"), (200_000_000, "2d ago")])
def test_age(spark, ms, expected):
    assert _one(spark, lambda c: S.age_label(c, 10**12), 10**12 - ms) == expected


@pytest.mark.parametrize(("n", "expected"), [(12, "12 B"), (1500, "1.5 KB"), (2_000_000, "2.0 MB"), (3_200_000_000, "3.2 GB")])
def test_bytes(spark, n, expected):
    assert _one(spark, S.format_bytes, n) == expected
