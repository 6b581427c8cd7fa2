"""Order-dependent operators against plain loops, and scenarios."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wirelake import fixtures, refdata
from wirelake.operators import assets, common, detections, hunts, identity, logs, matching, network, normalize
from wirelake.sources import files


def bindings(spark, rows):
    return spark.createDataFrame(rows, "event_time long, mac string, ip string, hostname string, lease_s int")


def walk(rows):
    """The resolver as a loop: asset number of each MAC."""
    mac_asset, name_asset, made = {}, {}, []
    for _, mac, _, name, _ in sorted(rows):
        if mac not in mac_asset:
            local = int(mac[:2], 16) & 2
            if local and name and name in name_asset:
                mac_asset[mac] = name_asset[name]
                continue
            mac_asset[mac] = mac
            made.append(mac)
        if name:
            name_asset[name] = mac_asset[mac]
    return mac_asset


def test_mac_assets_loop(spark):
    rng = random.Random(3)
    rows = [(t, f"{rng.choice(['00', '02', '06'])}:00:00:00:00:{rng.randrange(40):02X}", f"10.0.0.{rng.randrange(20)}", rng.choice(["", "a", "b", "c"]), 3600) for t in range(300)]
    found = {r["mac"]: r["root"] for r in identity.mac_assets(bindings(spark, rows)).collect()}
    assert found == walk(rows)


def test_resolution_follows_the_last_binding(spark):
    b = bindings(spark, [(10, "00:A", "10.0.0.1", "", 1), (86_400_000 * 3, "00:B", "10.0.0.1", "", 1)])
    events = spark.createDataFrame([(5, "10.0.0.1"), (10, "10.0.0.1"), (86_400_000 * 2, "10.0.0.1"), (86_400_000 * 3 + 1, "10.0.0.1"), (86_400_000 * 9, "10.0.0.1"), (50, "10.0.0.2")], "event_time long, src_ip string")
    found = sorted((r["event_time"], r["src_ip"], r["mac"]) for r in identity.resolve_ip(events, b).collect())
    assert [m for _, _, m in found] == [None, "00:A", None, "00:A", "00:B", "00:B"]


def test_conflict_and_fallback(spark):
    b = bindings(spark, [(1, "00:A", "10.0.0.1", "", 1), (2, "00:B", "10.0.0.1", "", 1)])
    assert identity.ip_conflicts(b).collect()[0].asDict() == {"event_time": 2, "ip": "10.0.0.1", "old_mac": "00:A", "mac": "00:B"}
    events = spark.createDataFrame([(5, "10.9.9.9"), (4, "10.9.9.9"), (5, "8.8.8.8"), (5, "")], "event_time long, src_ip string")
    assert [tuple(r) for r in identity.fallback_assets(identity.resolve_ip(events, b)).collect()] == [("10.9.9.9", 4)]


def test_risk_decay_loop(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("xyz"), rng.randrange(40_000_000), rng.choice([20, 40, 60, 80])) for i in range(400)]
    found = {r["id"]: r["risk"] for r in detections.risk_decay(spark.createDataFrame(rows, "id long, asset_id string, event_time long, points int")).collect()}
    for entity in "xyz":
        own = sorted((t, i, p) for i, e, t, p in rows if e == entity)
        for (_, i, _), risk in zip(own, detections.decayed([t for t, _, _ in own], [p for _, _, p in own])):
            assert found[i] == risk


def test_dedup_loop(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("st"), rng.choice("ab"), rng.randrange(20_000_000)) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, signal_id string, asset_id string, event_time long")
    found = {r["id"] for r in detections.dedup_alerts(frame, per_hour=10**6).collect()}
    expected = set()
    for key in {(s, a) for _, s, a, _ in rows}:
        own = sorted((t, i) for i, s, a, t in rows if (s, a) == key)
        expected |= {i for (_, i), keep in zip(own, detections.kept_alerts([t for t, _ in own], 300_000, 900_000)) if keep}
    assert found == expected


def test_correlation_loop(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["A", "B", "C", "D"]), rng.choice("pq"), rng.randrange(5_000_000)) for i in range(120)]
    frame = spark.createDataFrame(rows, "id long, signal_id string, asset_id string, event_time long")
    found = sorted((r["asset_id"], r["start_time"], r["signal_ids"]) for r in detections.correlate_use_case(frame, ("A", "B", "C"), 600_000).collect())
    expected = []
    for entity in "pq":
        own = sorted((t, i, s) for i, s, a, t in rows if a == entity)
        for k, (t, i, s) in enumerate(own):
            if s != "A":
                continue
            ends = [(tc, [i, ib, ic]) for m, (tb, ib, sb) in enumerate(own) if m > k and sb == "B" for n, (tc, ic, sc) in enumerate(own) if n > m and sc == "C"]
            if ends and min(ends)[0] - t <= 600_000:
                expected.append((entity, t, ",".join(map(str, min(ends)[1]))))
    assert found == sorted(expected)


def test_envelope_shapes(spark):
    rows = ['{"conn": {"ts": 1700000000.123, "uid": "C1", "id.orig_h": "192.168.1.100", "id.orig_p": 50000, "id.resp_h": "8.8.8.8", "id.resp_p": 443, "proto": "tcp", "tunnel_parents": ["a", "b"]}}', '{"log_type": "dns", "ts": "1700000000", "uid": "D1", "query": "x.y", "id.orig_p": "53"}', '{"_path": "http", "ts": "2023-11-14T22:13:20Z", "uid": "H1"}', "{broken", "{}", '{"foo": {"a": 1}}', ""]
    good, bad = normalize.split_dead_letters(normalize.parse_envelope(spark.createDataFrame([(r,) for r in rows], "value string")))
    conn = normalize.project_table(good, "conn").collect()[0]
    assert (conn["event_time"], conn["direction"], conn["service"], conn["event_hour"], conn["event_weekday"], conn["tunnel_parents"]) == (1700000000123, "outbound", "https", 22, 2, '["a","b"]')
    dns = normalize.project_table(good, "dns", zero_fill=True).collect()[0]
    assert (dns["event_time"], dns["query"], dns["id_orig_p"], dns["rcode"], dns["AA"]) == (1700000000000, "x.y", 0, 0, False)
    assert normalize.project_table(good, "http").collect()[0]["event_time"] == 1700000000000
    assert sorted(r["error_type"] for r in bad.collect()) == ["missing_log_type", "parse_error", "parse_error", "unknown_log_type"]


@pytest.mark.parametrize("log_type", normalize.schemas.LOG_TYPES)
def test_every_type_has_a_table(spark, log_type):
    value = '{"%s": {"ts": 1, "uid": "u"}}' % log_type
    good, _ = normalize.split_dead_letters(normalize.parse_envelope(spark.createDataFrame([(value,)], "value string")))
    table = normalize.project_table(good, log_type)
    assert len(set(table.columns)) == len(table.columns)
    assert table.first()["event_time"] == 1000


def test_lake_round_trip(spark, sf, tmp_path):
    conn = fixtures.table(spark, sf, "conn").limit(500).withColumn("log_type", F.lit("conn")).withColumn("ingest_time", F.col("event_time")).withColumn("ftx_id", F.col("flow_id"))
    files.write_lake(conn, str(tmp_path / "lake"), files_per_hour=2)
    lake = files.open_lake(spark, str(tmp_path / "lake"), views=False)
    assert list(lake) == ["conn"] and lake["conn"].count() == 500
    assert lake["conn"].filter("day = '05'").count() == conn.filter("event_time >= 1704412800000 AND event_time < 1704499200000").count()
    assert {r["status"] for r in files.table_counts(lake).collect()} == {"active"}
    assert files.schema_catalog(spark, lake).filter("field = 'orig_bytes'").first()["type"] == "bigint"


def test_one_folder_a_type(spark, sf, tmp_path):
    fixtures.table(spark, sf, "dns").limit(20).write.parquet(str(tmp_path / "dns"))
    (tmp_path / "http").mkdir()
    lake = files.open_lake(spark, str(tmp_path), views=False)
    assert list(lake) == ["dns"] and lake["dns"].count() == 20


def test_compact_hours(spark, sf, tmp_path):
    conn = fixtures.table(spark, sf, "conn").withColumn("log_type", F.lit("conn")).withColumn("ingest_time", F.col("event_time")).withColumn("ftx_id", F.col("flow_id"))
    base, to, before = str(tmp_path / "lake"), str(tmp_path / "compact"), 1704412800000
    for part in conn.randomSplit([1.0, 1.0, 1.0], seed=1):
        files.write_lake(part.filter(F.col("event_time") < before + 7_200_000), base)
    for _ in range(2):  # the second run replaces the first
        files.compact_hours(spark, base, to, before)
    rows = files.open_lake(spark, to, views=False)["conn"]
    assert sorted(r[0] for r in rows.select("flow_id").collect()) == sorted(r[0] for r in conn.filter(F.col("event_time") < before).select("flow_id").collect())
    assert rows.select("day", "hour", F.input_file_name().alias("file")).groupBy("day", "hour").agg(F.count_distinct("file").alias("files")).filter("files > 1").isEmpty()


def test_bundle_is_written_by_window_and_source(spark, sf, tmp_path):
    lake = fixtures.lake(spark, sf, "conn", "dns")
    bundle = logs.lake_bundle(lake, ("24h", "all"), fixtures.NOW_MS)
    logs.write_bundle(bundle, str(tmp_path / "bundle"))
    back = spark.read.parquet(str(tmp_path / "bundle")).select(bundle.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, bundle.collect()))
    assert back.filter("window = 'all' AND log_type = 'dns' AND widget = 'hour'").agg(F.sum("n")).first()[0] == lake["dns"].count()


def test_reference_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("# head\n\n a , b,c, d \nx,y,z\n")
    assert sorted(tuple(r) for r in files.load_reference_csv(spark, str(tmp_path / "x.csv"), ["p", "q", "r"]).collect()) == [("a", "b", "c, d"), ("x", "y", "z")]


def test_zeek_json(spark, tmp_path):
    (tmp_path / "dns.log").write_text('{"ts": 1.5, "uid": "a", "id.orig_h": "10.0.0.1", "query": "q"}\nnot json\n')
    row = files.read_zeek_json(spark, str(tmp_path / "dns.log"), "dns").collect()
    assert len(row) == 1 and (row[0]["event_time"], row[0]["src_ip"], row[0]["query"]) == (1500, "10.0.0.1", "q")


def test_triage(spark):
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(["ok", "an ERROR", "critical drop", "warn x", "y" * 500 + " failed"])], "file string, line_no long, value string")
    found = {r["line_no"]: (r["level"], len(r["line"])) for r in files.triage_lines(lines).collect()}
    assert found == {1: ("error", 8), 2: ("critical", 13), 3: ("warning", 6), 4: ("info", 400)}


def test_merge_equals_whole(spark, sf):
    lake = fixtures.lake(spark, sf, "conn", "dns")
    cut = 1705300000000
    a = assets.asset_profiles({n: d.filter(F.col("event_time") < cut) for n, d in lake.items()})
    b = assets.asset_profiles({n: d.filter(F.col("event_time") >= cut) for n, d in lake.items()})
    assert sorted(map(tuple, assets.merge_profiles(a, b).collect())) == sorted(map(tuple, assets.asset_profiles(lake).collect()))


def test_suffixes_and_blocks(spark):
    names = spark.createDataFrame([("a.evil-domain.com",), ("evil-domain.com.",), ("notevil-domain.com",), (None,), ("",)], "query string")
    assert sorted(r["query"] for r in matching.threat_domains(names).collect()) == ["a.evil-domain.com", "evil-domain.com."]
    ips = spark.createDataFrame([("162.142.125.7",), ("162.142.126.7",), ("71.6.135.131",), ("bad",), (None,)], "src_ip string")
    assert sorted(r["src_ip"] for r in matching.scanner_hits(ips).collect()) == ["162.142.125.7", "71.6.135.131"]
    assert matching.suppress_scanners(ips).count() == 3


def test_matches_any_takes_patterns_literally(spark):
    rows = spark.createDataFrame([("x' OR 1=1 --",), ("sleep(5)",), ("CHAR(64)",), ("fine",)], "uri string")
    assert matching.sqli_patterns(rows).count() == 3
    assert all(matching.first_match(F.lit("x"), refdata.SQLI_PATTERNS) is not None for _ in range(1))


def test_sql_guard():
    assert hunts.read_only("SELECT 1;") == "SELECT 1"
    for bad in ("DROP TABLE x", "select 1; select 2", "with a as (select 1) insert into b select * from a", ""):
        with pytest.raises(ValueError):
            hunts.read_only(bad)


def test_conditions(spark):
    df = spark.createDataFrame([("1", 9), ("2", 10), ("3", 100)], "flow_id string, port int")
    assert hunts.hunt_rows(df, ("port", "GREATER", "9")).count() == 2
    assert df.filter(hunts.search_condition(df, ("port", ">", "9"))).count() == 0  # by characters
    assert hunts.search_condition(df, ("none", "==", "x")) is None
    with pytest.raises(ValueError):
        hunts.search_condition(df, ("a b", "==", "x"))


def test_port_risks(spark):
    """Levels of TCP ports, written out here; other transports and ports have none."""
    expected = {1337: "critical", 4444: "critical", 4445: "critical", 31337: "critical", 50050: "critical", 9200: "high", 9300: "high", 11211: "high", 27017: "high", 6379: "high", 9090: "medium", 3389: "medium", 445: "medium", 8443: "low", 8080: "low", 443: None}
    rows = [("10.0.0.1", "8.8.8.8", p, "tcp", 1, 1) for p in expected] + [("10.0.0.1", "8.8.8.8", 4444, "udp", 1, 1)]
    frame = spark.createDataFrame(rows, "src_ip string, dst_ip string, dst_port int, protocol string, orig_bytes long, resp_bytes long")
    found = {(r["dst_port"], r["protocol"]): r["risk_level"] for r in network.service_risk(frame, 100).collect()}
    assert found == {(p, "tcp"): level for p, level in expected.items()} | {(4444, "udp"): None}
    assert len(refdata.PORT_RISKS) == 50


def test_typed_parse_in_one_and_two_steps(spark):
    """The record that the envelope reads gives the same table as a second parse, misfits and flat messages among them."""
    rows = ['{"conn": {"ts": 1, "uid": 5, "id.orig_p": "53", "proto": "tcp", "history": "12", "tunnel_parents": ["a"], "orig_bytes": true}}', '{"log_type": "conn", "ts": "2", "uid": "7", "proto": {"x": 1}, "service": "s"}', '{"conn": 5, "_path": "conn", "uid": "z"}', '{"conn": {"ts": 1', '{"log_type": 4, "_path": "conn"}']
    frame = spark.createDataFrame([(r,) for r in rows], "value string")
    tables = []
    for log_type in (None, "conn"):
        good, bad = normalize.split_dead_letters(normalize.parse_envelope(frame, log_type=log_type))
        tables.append((sorted(map(repr, normalize.project_table(good, "conn").collect())), bad.count()))
    assert tables[0] == tables[1] and tables[0][1] == 1 and len(tables[0][0]) == 4
    found = {r["raw_log"]: r for r in normalize.project_table(good, "conn").collect()}
    one = found[rows[0]]
    assert (one["flow_id"], one["src_port"], one["protocol"], one["history"], one["tunnel_parents"], one["orig_bytes"]) == (None, None, "tcp", "12", '["a"]', None)
    assert found[rows[1]]["flow_id"] == "7" and found[rows[1]]["protocol"] is None


def test_alert_activity_falls_back_to_signal_and_asset(spark):
    alerts = spark.createDataFrame(
        [(1, "S", "a", " x , y", 10), (2, "S", "a", "", 10), (3, "S", "a", None, 10), (4, "", "a", "", 10), (5, "S", None, "", 10), (6, "S", "a", "z", 2_000_000)],
        "id long, signal_id string, asset_id string, ftx_ids string, event_time long",
    )
    features = '{"features": {"bytes_in": 5, "orig_bytes": 2}}'
    signals = spark.createDataFrame(
        [(7, "S", "a", "x", 0, "h", "", features), (8, "S", "a", "", 20, "h", "k", features), (9, "S", "a", "z", 3_000_000, "h", "k", features), (10, "T", "a", "x,y", 30, "", "k", None)],
        "id long, signal_id string, asset_id string, ftx_ids string, event_time long, src_ip string, dst_ip string, evidence string",
    )
    got = {r["alert_id"]: tuple(r)[1:] for r in detections.alert_activity(alerts, signals).collect()}
    # 6 has a signal of its log id, though out of reach, so nothing else counts for it
    assert got == {1: (0, 2, 5, 2, 1, 1), 2: (0, 2, 10, 4, 1, 1), 3: (0, 2, 10, 4, 1, 1)}
    got = detections.alert_activity(alerts, signals, newest=2).filter("alert_id = 2").collect()
    assert [r["events"] for r in got] == [1]


def test_asset_ids_over_ranges(spark):
    rows = [(f"{i:012x}", f"{i:012x}", (i * 7919) % 500) for i in range(3000)]
    frame = spark.createDataFrame(rows, "mac string, root string, first_seen long")
    want = {mac: f"AST-{n:04d}" for n, (_, mac) in enumerate(sorted((t, m) for m, _, t in rows), 1)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r["mac"]: r["asset_id"] for r in identity.asset_ids(frame).collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_clean_result(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, double('NaN'), array(float('Infinity'), float(1)), timestamp'2024-01-01 00:00:00', date'2024-01-02'), (2, 0.5D, array(CAST(NULL AS float)), timestamp'2024-01-01 00:00:00.25', NULL), (3, NULL, NULL, NULL, NULL) AS t(n, `a.b`, c, t, d)")
    found = [tuple(r) for r in common.clean_result(rows).orderBy("n").collect()]
    assert found == [(1, None, [None, 1.0], "2024-01-01T00:00:00", "2024-01-02"), (2, 0.5, [None], "2024-01-01T00:00:00.250000", None), (3, None, None, None, None)]
    assert common.clean_result(rows.limit(0)).count() == 0
