"""State kept over batches: bindings in a stream, profiles in a log of parts, sketches of peers."""

from __future__ import annotations

import datetime
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wirelake import fixtures
from wirelake.operators import assets, identity
from wirelake.streaming import jobs
from wirelake.streaming.profile_log import ProfileLog

T0 = 1_700_000_000_000
EVENT = "id long, src_ip string, event_time long, note string, share double, seen timestamp"
BINDING = "event_time long, mac string, ip string"


def made(seed, n=120):
    rng = random.Random(seed)
    hosts = ["10.0.0.1"] * 4 + ["10.0.0.2", "10.0.0.3", "8.8.8.8", "", None]
    at = lambda: T0 + rng.randrange(0, 7_200_000, 500)
    events = [(i, rng.choice(hosts), at(), rng.choice(["a\"b", "", None, "é"]), rng.choice([0.1, None]), datetime.datetime(2024, 1, 1, 0, 0, 0, rng.randrange(10**6))) for i in range(n)]
    bindings = [(at(), rng.choice("PQR"), rng.choice(hosts[:6])) for _ in range(n // 3)] + [(events[0][2], "Z", "10.0.0.1")]
    return rng, events, bindings


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stream_identity_equals_the_batch(spark, tmp_path, seed):
    """Events and bindings together in any cuts of any sizes, each row up to nine minutes late."""
    rng, events, bindings = made(seed)
    arrivals = sorted([(e[2] + rng.randrange(540_000), 0, e) for e in events] + [(b[0] + rng.randrange(540_000), 1, b) for b in bindings], key=lambda x: x[0])
    cuts = sorted(rng.sample(range(1, len(arrivals)), 5))
    folders = str(tmp_path / "events"), str(tmp_path / "bindings")
    end = [(T0 + 10**9, 0, (10**6, "1.1.1.1", T0 + 10**9, None, None, None))]  # lets all before it go
    for part in [*(arrivals[a:b] for a, b in zip([0, *cuts], [*cuts, None])), end]:
        for kind, (folder, schema) in enumerate(zip(folders, (EVENT, BINDING))):
            spark.createDataFrame([x for _, k, x in part if k == kind], schema).coalesce(1).write.mode("append").parquet(folder)
    # a step of the two streams takes one file of each, so their files go together
    read = lambda folder, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    found = jobs.stream_identity(read(folders[0], EVENT), read(folders[1], BINDING), salts=3)
    query = found.writeStream.format("memory").queryName(f"bound{seed}").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    wanted = identity.resolve_ip(spark.createDataFrame(events, EVENT), spark.createDataFrame(bindings, BINDING))
    rows = spark.table(f"bound{seed}").filter(f"event_time < {T0 + 10**9}")
    assert rows.columns == wanted.columns
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, wanted.collect()))


def sizes(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_profile_log_equals_one_run(spark, sf, tmp_path):
    """Any cuts, batches that run again, several levels; sketches too."""
    conn = fixtures.table(spark, sf, "conn").limit(600)
    rows = assets.sides({"conn": conn}).withColumn("cut", F.floor(F.col("event_time") / 86_400_000) % 11).persist()
    log = ProfileLog(str(tmp_path / "log"), fan=2)
    assert log.last(spark) is None
    for n in range(11):
        batch = rows.filter(F.col("cut") == n).drop("cut")
        log.merge(batch, n)
        if n in (3, 6):
            log.merge(batch, n)  # again
    assert log.last(spark) == 10 and log.parts(10) == [(3, 0), (1, 4), (0, 10)]
    whole = assets.counters(rows.drop("cut"), sketched=True)
    plain = [c for c in whole.columns if c not in assets.PEERS]
    assert sorted(map(tuple, log.profiles(spark).select(*plain).collect())) == sorted(map(tuple, whole.select(*plain).collect()))
    estimate = lambda df: sorted(map(tuple, assets.peer_estimates(df).collect()))
    assert estimate(log.profiles(spark)) == estimate(whole)
    earlier = assets.counters(rows.filter("cut <= 9"), sketched=True)
    assert sorted(map(tuple, log.profiles(spark, 9).select(*plain).collect())) == sorted(map(tuple, earlier.select(*plain).collect()))
    rows.unpersist()


def side(ip, t):
    return ("conn", t, 1, 1, "src", ip, "10.9.9.9")


def test_profile_log_writes_as_much_as_a_batch(spark, tmp_path):
    """After a large first batch, small ones write small parts until the large one's level is full."""
    schema = "log_type string, event_time long, orig_bytes long, resp_bytes long, role string, ip string, peer string"
    log = ProfileLog(str(tmp_path / "log"), fan=4)
    many = spark.range(60_000).select(F.lit("conn").alias("log_type"), F.lit(T0).alias("event_time"), F.lit(1).cast("long").alias("orig_bytes"), F.lit(1).cast("long").alias("resp_bytes"), F.lit("src").alias("role"), F.concat(F.lit("10."), F.col("id") % 250, F.lit("."), F.floor(F.col("id") / 250), F.lit(".1")).alias("ip"), F.lit("10.9.9.9").alias("peer"))
    log.merge(many, 0)
    large = sizes(tmp_path / "log")
    before = large
    for n in range(1, 3):
        log.merge(spark.createDataFrame([side("10.1.0.1", T0 + n)], schema), n)
        assert sizes(tmp_path / "log") - before < large / 5
        before = sizes(tmp_path / "log")


def test_profile_log_forgets(spark, tmp_path):
    schema = "log_type string, event_time long, orig_bytes long, resp_bytes long, role string, ip string, peer string"
    log = ProfileLog(str(tmp_path / "log"), fan=2, ttl_ms=1000)
    for n, batch in enumerate([[("a", 0), ("b", 0)], [("a", 900)], [("a", 1800), ("c", 2000)], [("b", 2500), ("a", 2600)], [("b", 2700)]]):
        log.merge(spark.createDataFrame([side(f"10.0.0.{ord(ip)}", T0 + t) for ip, t in batch], schema), n)
    found = {chr(int(r["ip"].split(".")[-1])): (r["total_events"], r["first_seen"] - T0) for r in log.profiles(spark).collect()}
    assert found == {"a": (4, 0), "b": (2, 2500), "c": (1, 2000)}  # b was silent for 2500 ms and began anew
    log.merge(spark.createDataFrame([side("10.0.0.99", T0 + 9000)], schema), 5)
    assert {r["ip"] for r in log.profiles(spark).collect()} == {"10.0.0.99"}


def test_sketches_merge(spark, sf):
    """Parts merged estimate what the whole does, within five per cent of the exact number."""
    conn = fixtures.table(spark, sf, "conn")
    part = lambda k: assets.asset_profiles({"conn": conn.filter(f"src_port % 3 = {k}")}, sketched=True)
    merged = assets.merge_profiles(assets.merge_profiles(part(0), part(1)), part(2))
    estimate = {tuple(r) for r in assets.peer_estimates(merged).collect()}
    assert estimate == {tuple(r) for r in assets.peer_estimates(assets.asset_profiles({"conn": conn}, sketched=True)).collect()}
    exact = {r["ip"]: r for r in assets.unique_peers({"conn": conn}).collect()}
    assert all(abs(d - exact[ip]["destinations"]) <= 0.05 * exact[ip]["destinations"] and abs(s - exact[ip]["sources"]) <= 0.05 * exact[ip]["sources"] for ip, d, s in estimate if ip in exact)
