"""Network-log tables derived from general test tables, as the same expressions for Spark and other SQL engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The fixed present of all windows: 2024-01-31 00:00:00 UTC.
NOW_MS = 1706659200000
START_MS = 1704067200000


def _host(key: str) -> str:
    return f"concat('10.0.', CAST({key} % 8 AS STRING), '.', CAST(1 + {key} % 250 AS STRING))"


def _time(key: str) -> str:
    return f"{START_MS} + (({key}) % 2592000)*1000"


#: name: (base table, {column: expression}, condition)
TABLES: dict[str, tuple[str, dict[str, str], str]] = {
    "conn": (
        "lineitem",
        {
            "flow_id": "concat('C', CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_linenumber AS STRING))",
            "event_time": _time("l_orderkey*7919 + l_partkey*104729 + l_suppkey*1299709 + l_linenumber*15485863"),
            "src_ip": f"CASE WHEN l_orderkey % 5 = 0 THEN '10.0.0.1' WHEN l_suppkey % 10 = 9 THEN concat('203.0.113.', CAST(l_suppkey % 250 AS STRING)) ELSE {_host('l_suppkey')} END",
            "dst_ip": f"CASE l_partkey % 4 WHEN 0 THEN concat('192.168.1.', CAST(l_partkey % 250 AS STRING)) WHEN 1 THEN concat('172.', CAST(14 + l_partkey % 20 AS STRING), '.0.', CAST(l_partkey % 250 AS STRING)) WHEN 2 THEN concat('198.51.100.', CAST(l_partkey % 250 AS STRING)) ELSE {_host('l_partkey')} END",
            "src_port": "1024 + (l_orderkey*31 + l_linenumber) % 60000",
            "dst_port": "CASE l_partkey % 9 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 53 WHEN 3 THEN 22 WHEN 4 THEN 3389 WHEN 5 THEN 8080 WHEN 6 THEN 4444 WHEN 7 THEN 67 ELSE 31337 END",
            "protocol": "CASE l_linenumber % 4 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' WHEN 2 THEN 'icmp' ELSE NULL END",
            "conn_state": "CASE WHEN l_returnflag = 'A' THEN 'SF' WHEN l_returnflag = 'R' THEN 'REJ' WHEN l_linestatus = 'F' THEN 'S0' ELSE 'RSTO' END",
            "orig_bytes": "CAST(floor(l_extendedprice*l_quantity) AS BIGINT)",
            "resp_bytes": "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) END",
            "duration": "l_quantity/10",
        },
        "",
    ),
    "dns": (
        "events",
        {
            "flow_id": "concat('D', CAST(event_id AS STRING))",
            "event_time": _time("event_id*7919"),
            "src_ip": _host("user_id"),
            "dst_ip": "'8.8.8.8'",
            "protocol": "'udp'",
            "query": "CASE WHEN event_id % 50 = 0 THEN concat(repeat('a', CAST(40 + user_id % 30 AS INT)), '.tunnel.evil.com') WHEN event_id % 41 = 0 THEN 'www.malware-c2.net' WHEN event_id % 37 = 0 THEN '-' WHEN event_id % 3 = 0 THEN 'time.nist.gov' ELSE concat('h', CAST(user_id % 40 AS STRING), '.example.com') END",
            "qtype_name": "CASE event_id % 7 WHEN 0 THEN 'AAAA' WHEN 1 THEN 'TXT' ELSE 'A' END",
            "rcode_name": "CASE WHEN event_id % 11 = 0 THEN 'NXDOMAIN' ELSE 'NOERROR' END",
        },
        "event_type IN ('view', 'click')",
    ),
    "http": (
        "events",
        {
            "flow_id": "concat('H', CAST(event_id AS STRING))",
            "event_time": _time("event_id*104729"),
            "src_ip": _host("user_id"),
            "dst_ip": "concat('198.51.100.', CAST((event_id*4 + 2) % 250 AS STRING))",
            "dst_port": "CASE WHEN event_id % 9 = 0 THEN 8088 ELSE 80 END",
            "method": "CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END",
            "host": "CASE WHEN event_id % 29 = 0 THEN '' ELSE concat('h', CAST(user_id % 40 AS STRING), '.example.com') END",
            "uri": "CASE event_id % 13 WHEN 0 THEN '/a.php?cmd=id' WHEN 1 THEN '/q?x=1 union select 2' WHEN 2 THEN '/dl/tool.exe' ELSE '/index.html' END",
            "user_agent": "CASE event_id % 6 WHEN 0 THEN 'curl/8.0' WHEN 1 THEN 'WindowsPowerShell/5.1' WHEN 2 THEN 'python-requests/2.3' WHEN 3 THEN 'Mozilla/5.0 (Windows NT 10.0)' WHEN 4 THEN 'Mozilla/5.0 (Linux; Android 13)' ELSE 'Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15)' END",
            "status_code": "CASE WHEN event_type = 'error' THEN 404 + event_id % 100 ELSE 200 END",
            "password": "CASE WHEN event_id % 17 = 0 THEN 'secret' ELSE NULL END",
        },
        "event_type IN ('purchase', 'error', 'signup')",
    ),
    "dhcp": (
        "customer",
        {
            "flow_id": "concat('L', CAST(c_custkey AS STRING))",
            "event_time": _time("c_custkey*15485863"),
            "mac": "concat(CASE c_custkey % 5 WHEN 0 THEN '00:50:56' WHEN 1 THEN '00:00:0C' WHEN 2 THEN '02:AA:BB' WHEN 3 THEN '18:B4:30' ELSE '06:11:22' END, ':', lpad(CAST(CAST(floor(c_custkey/10000) AS BIGINT) % 100 AS STRING), 2, '0'), ':', lpad(CAST(CAST(floor(c_custkey/100) AS BIGINT) % 100 AS STRING), 2, '0'), ':', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'))",
            "assigned_addr": _host("c_custkey"),
            "host_name": "CASE WHEN c_custkey % 6 = 0 THEN '' ELSE concat('host-', CAST(c_custkey % 40 AS STRING)) END",
            "lease_time": "3600",
        },
        "",
    ),
    "ssl": (
        "orders",
        {
            "flow_id": "concat('S', CAST(o_orderkey AS STRING))",
            "event_time": _time("o_orderkey*7919 + o_custkey"),
            "src_ip": _host("o_custkey"),
            "dst_ip": "concat('198.51.100.', CAST(o_orderkey % 250 AS STRING))",
            "dst_port": "CASE WHEN o_orderkey % 10 = 0 THEN 8443 ELSE 443 END",
            "ja3": "CASE o_custkey % 5 WHEN 0 THEN 'eb1d94daa7e0344597e756a1fb6e7054' WHEN 1 THEN 'e7d705a3286e19ea42f587b344ee6865' WHEN 2 THEN '72a589da586844d7f0818ce684948eea' WHEN 3 THEN '' ELSE 'ffffffffffffffffffffffffffffffff' END",
        },
        "",
    ),
    "ntlm": (
        "events",
        {
            "flow_id": "concat('N', CAST(event_id AS STRING))",
            "event_time": _time("event_id*15485863"),
            "src_ip": _host("user_id"),
            "dst_ip": "'10.0.0.10'",
            "hostname": "CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('NT-', CAST(user_id % 30 AS STRING)) END",
        },
        "event_type = 'signup'",
    ),
    "kerberos": (
        "events",
        {
            "flow_id": "concat('K', CAST(event_id AS STRING))",
            "event_time": _time("event_id*1299709"),
            "src_ip": f"CASE WHEN user_id % 3 = 0 THEN concat('10.7.0.', CAST(user_id % 200 AS STRING)) ELSE {_host('user_id')} END",
            "dst_ip": "'10.0.0.10'",
            "client": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('user', CAST(user_id % 60 AS STRING), '/EXAMPLE') END",
        },
        "event_type = 'purchase'",
    ),
    "alerts": (
        "orders",
        {
            "id": "o_orderkey",
            "alert_type": "CASE WHEN o_orderkey % 4 = 0 THEN 'use_case' ELSE 'signal' END",
            "name": "concat('Alert ', CAST(o_custkey % 25 AS STRING))",
            "signal_id": "concat('SIG-', lpad(CAST(o_custkey % 12 AS STRING), 3, '0'))",
            "asset_id": _host("o_custkey"),
            "src_ip": _host("o_custkey"),
            "dst_ip": f"CASE WHEN o_orderkey % 3 = 0 THEN {_host('o_orderkey')} ELSE concat('198.51.100.', CAST(o_orderkey % 250 AS STRING)) END",
            "severity": "CASE o_custkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END",
            "category": "CASE o_orderkey % 6 WHEN 0 THEN 'c2' WHEN 1 THEN 'exfiltration' WHEN 2 THEN 'ransomware' WHEN 3 THEN 'lateral_movement' WHEN 4 THEN 'reconnaissance' ELSE NULL END",
            "mitre_tactic": "CASE o_orderkey % 5 WHEN 0 THEN 'Exfiltration' WHEN 1 THEN 'Discovery' WHEN 2 THEN 'Impact' WHEN 3 THEN '' ELSE NULL END",
            "status": "CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'F' THEN 'resolved' ELSE 'investigating' END",
            "risk_score": "CAST(floor(o_totalprice) AS BIGINT) % 100",
            "ftx_ids": "concat('E', CAST(o_orderkey % 1000 AS STRING), ',E', CAST((o_orderkey + 7) % 1000 AS STRING))",
            "event_time": _time("o_orderkey*104729"),
        },
        "",
    ),
    "raw_signals": (
        "events",
        {
            "id": "event_id",
            "signal_id": "concat('SIG-', lpad(CAST(user_id % 12 AS STRING), 3, '0'))",
            "asset_id": _host("user_id"),
            "src_ip": _host("user_id"),
            "dst_ip": "concat('198.51.100.', CAST(event_id % 250 AS STRING))",
            "detection_method": "CASE event_type WHEN 'error' THEN 'hybrid' WHEN 'purchase' THEN 'zscore' WHEN 'signup' THEN 'ml' ELSE 'rule' END",
            "evidence": """concat('{"features": {"bytes_in": ', CAST(event_id % 5000 AS STRING), ', "orig_bytes": ', CAST(event_id % 700 AS STRING), '}}')""",
            "ftx_ids": "concat('E', CAST(event_id % 1000 AS STRING))",
            "visibility_mode": "CASE WHEN event_id % 3 = 0 THEN 'anomaly' WHEN event_id % 3 = 1 THEN 'alert' ELSE 'hidden' END",
            "event_time": _time("event_id*7919"),
        },
        "",
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns, condition = TABLES[name]
    rows = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    if condition:
        rows = rows.filter(condition)
    return rows.selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files."""
    base, columns, condition = TABLES[name]
    path = f"{sf_dir}/{base}.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(path if "*" in path else f"{path}*")
    if condition:
        rows = rows.filter(condition)
    return rows.selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def lake(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names or TABLES}


def sql(name: str) -> str:
    """The table as a SELECT over its base table."""
    base, columns, condition = TABLES[name]
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {base}" + (f" WHERE {condition}" if condition else "")
