"""Streams over small time-ordered files equal the batch."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wirelake import fixtures
from wirelake.operators import assets, detections, identity, normalize
from wirelake.plans import catalog
from wirelake.streaming import jobs
from wirelake.streaming.profile_log import ProfileLog


@pytest.fixture
def stream(spark, tmp_path):
    def make(df, files=3, order="event_time"):
        path = str(tmp_path / f"in{len(list(tmp_path.iterdir()))}")
        part = F.ntile(files).over(Window.orderBy(order))
        rows = df.withColumn("_part", part).persist()
        for i in range(files):
            rows.filter(F.col("_part") == i + 1).drop("_part").coalesce(1).write.mode("append").parquet(path)
        rows.unpersist()
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return make


def run(df, mode, tmp_path, name):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def test_normalize(spark, sf, stream, tmp_path):
    messages = catalog._messages(fixtures.table(spark, sf, "conn").limit(300))
    good, bad = jobs.stream_normalize(stream(messages, order="value"))
    assert run(good, "append", tmp_path, "good").count() + run(bad, "append", tmp_path, "bad").count() == 300


def test_profiles(spark, sf, stream, tmp_path):
    conn = fixtures.table(spark, sf, "conn").limit(400)
    found = run(jobs.stream_profiles({"conn": stream(conn)}), "complete", tmp_path, "profiles")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, assets.asset_profiles({"conn": conn}).collect()))


def test_profile_log_in_a_stream(spark, sf, stream, tmp_path):
    conn = fixtures.table(spark, sf, "conn").limit(400)
    log = ProfileLog(str(tmp_path / "profiles"), fan=2)
    query = assets.sides({"conn": stream(conn)}).writeStream.foreachBatch(log.merge).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = log.profiles(spark).drop(*assets.PEERS)
    wanted = assets.asset_profiles({"conn": conn})
    assert sorted(map(tuple, found.select(*wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))


def test_profiles_by_window_leave_state(spark, sf, stream, tmp_path):
    conn = fixtures.table(spark, sf, "conn").limit(400)
    parts = run(jobs.stream_profiles({"conn": stream(conn)}, "1 day"), "append", tmp_path, "windows")
    whole = {r["ip"]: r["total_events"] for r in assets.asset_profiles({"conn": conn}).collect()}
    found = {r["ip"]: r["n"] for r in parts.groupBy("ip").agg(F.sum("total_events").alias("n")).collect()}
    assert found and all(n <= whole[ip] for ip, n in found.items())  # the last window stays open


def test_threshold(spark, sf, stream, tmp_path):
    conn = fixtures.table(spark, sf, "conn")
    found = run(jobs.stream_threshold_signals(stream(conn), "src_ip", "conn_state IN ('REJ', 'S0')", 3, "1 hour"), "append", tmp_path, "thresholds").collect()
    batch = {tuple(r) for r in catalog.QUERIES["threshold_rules"](spark, sf).collect()}
    assert found and {tuple(r) for r in found} <= batch  # the last window stays open


def test_dedup_and_sessions(spark, sf, stream, tmp_path):
    alerts = fixtures.table(spark, sf, "alerts")
    found = run(jobs.stream_dedup(stream(alerts)), "append", tmp_path, "dedup")
    assert 0 < found.count() <= alerts.count()
    conn = fixtures.table(spark, sf, "conn")
    sessions = run(jobs.stream_sessions(stream(conn)), "append", tmp_path, "sessions").collect()
    assert {tuple(r) for r in sessions} <= {tuple(r) for r in catalog.QUERIES["activity_sessions"](spark, sf).collect()}


def test_metrics_and_rules(spark, sf, stream, tmp_path):
    conn = fixtures.table(spark, sf, "conn").limit(500).select("event_time", (F.col("event_time") + 20).alias("ingest_time"), F.lit("conn").alias("log_type"))
    metrics = run(jobs.stream_metrics(stream(conn)), "append", tmp_path, "metrics").collect()
    assert metrics and all(r["p95_ms"] == 20 for r in metrics)
    values = conn.select("event_time", F.lit("errors").alias("metric"), F.lit(200).cast("long").alias("value"))
    rules = run(jobs.stream_alert_rules(stream(values), "errors", 100), "append", tmp_path, "rules").collect()
    assert rules and all(r["value"] > 100 for r in rules)


def test_correlation(spark, stream, tmp_path):
    rows = spark.createDataFrame([(1, "A", "x", 1000), (2, "B", "x", 2000), (3, "A", "y", 1000), (4, "B", "y", 9_000_000), (5, "A", "x", 9_000_001), (6, "B", "x", 9_000_002)], "id long, signal_id string, asset_id string, event_time long")
    found = run(jobs.stream_correlation(stream(rows), ("A", "B"), 600_000), "append", tmp_path, "chains").collect()
    assert sorted(map(tuple, found)) == [("x", 1000, 2000), ("x", 9_000_001, 9_000_002)]


def test_correlation_equals_the_batch(spark, stream, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choice("ABCD"), rng.choice("xy"), 100_000 + i * 7_000 + rng.randrange(7_000)) for i in range(150)]
    frame = spark.createDataFrame(rows, "id long, signal_id string, asset_id string, event_time long")
    for name, stages in (("abc", ("A", "B", "C")), ("aab", ("A", "A", "B"))):
        found = run(jobs.stream_correlation(stream(frame), stages, 120_000), "append", tmp_path, f"chains_{name}").collect()
        batch = detections.correlate_use_case(frame, stages, 120_000).select("asset_id", "start_time", "end_time").collect()
        assert found and sorted(map(tuple, found)) == sorted(map(tuple, batch))


def test_latency_buckets_rules_and_outcomes(spark, sf, stream, tmp_path):
    conn = fixtures.table(spark, sf, "conn").limit(400).select("event_time", (F.col("event_time") + F.when(F.col("flow_id").like("%1"), 6000).otherwise(40)).alias("ingest_time"), F.lit("conn").alias("log_type"))
    metrics = run(jobs.stream_metrics(stream(conn)), "append", tmp_path, "latency").collect()
    assert metrics and all(r["le_50"] + r["slow"] == r["events"] for r in metrics)
    slow = conn.withColumn("ingest_time", F.col("event_time") + 7000)
    assert all(r["p95_ms"] == 7000 for r in run(jobs.stream_latency_rule(stream(slow)), "append", tmp_path, "p95").collect())
    messages = catalog._messages(fixtures.table(spark, sf, "conn").limit(300)).withColumn("arrival", F.lit(1_700_000_000_000))
    late = messages.limit(1).withColumn("arrival", F.lit(1_800_000_000_000))
    parsed = normalize.parse_envelope(stream(messages.unionByName(late), order="arrival"))
    first = min(run(jobs.stream_outcomes(parsed), "append", tmp_path, "outcomes").collect(), key=lambda r: r["window"])
    assert first["consumed"] == 300 and first["enriched"] + first["parse_errors"] + first["dead_letters"] == 300


def test_identity_batches_replace_themselves(spark, sf, stream, tmp_path):
    conn = fixtures.table(spark, sf, "conn").limit(200).select("flow_id", "src_ip", "event_time")
    bindings = identity.dhcp_bindings(fixtures.table(spark, sf, "dhcp"))
    resolve = jobs.batch_identity(bindings, str(tmp_path / "resolved"))
    resolve(conn, 0)
    resolve(conn, 0)  # run again
    found = spark.read.parquet(str(tmp_path / "resolved")).drop("batch")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, identity.resolve_ip(conn, bindings).collect()))


def test_lookup(spark, sf, stream, tmp_path):
    conn = fixtures.table(spark, sf, "conn").limit(100)
    names = spark.createDataFrame([(443, "https")], "dst_port int, name string")
    assert run(jobs.stream_lookup(stream(conn), names, "dst_port", "inner"), "append", tmp_path, "lookup").count() == conn.filter("dst_port = 443").count()
