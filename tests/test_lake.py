"""The lake by hours: windows read their folders alone, refreshes read new hours alone, one job writes all outputs once."""

from __future__ import annotations

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wirelake import fixtures, schemas
from wirelake.fixtures import NOW_MS
from wirelake.operators import identity, logs, normalize, rollup
from wirelake.operators.common import in_hours, in_window
from wirelake.plans import catalog
from wirelake.sources import files
from wirelake.streaming import enrich

HOUR = 3_600_000


@pytest.fixture(scope="module")
def base(spark, sf, tmp_path_factory):
    """Three days of connections and names in a lake, with the columns of the test tables."""
    path = str(tmp_path_factory.mktemp("lake"))
    for name in ("conn", "dns"):
        rows = fixtures.table(spark, sf, name).filter(f"event_time >= {NOW_MS - 72 * HOUR}").withColumn("ingest_time", F.col("event_time"))
        files.write_lake(rows.withColumn("log_type", F.lit(name)), path)
    return path


def opened(spark, path):
    return files.open_lake(spark, path, ("conn", "dns", "http"), views=False)


def plan_of(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


def test_declared_tables(spark, base):
    lake = opened(spark, base)
    assert sorted(lake) == ["conn", "dns"]
    for name, df in lake.items():
        assert set(df.columns) == {f.name for f in normalize.table_schema(spark, name)} | {"year", "month", "day", "hour"}
    assert lake["conn"].filter("orig_bytes IS NOT NULL AND missed_bytes IS NULL").count() == lake["conn"].count() > 0


def test_a_window_reads_its_hours(spark, base, capsys):
    """An hour's window lists the folders of that hour; the same rows as without folders."""
    conn = opened(spark, base)["conn"]
    for label, hours in (("1h", 1), ("24h", 24), ("7d", 168)):
        found = in_window(conn, label, NOW_MS)
        low = NOW_MS - hours * HOUR
        assert found.count() == conn.filter(f"ingest_time >= {low}").count()
        folders = {r[0].split("hour=")[1].split("/")[0] + r[0].split("day=")[1].split("/")[0] for r in found.select(F.input_file_name()).distinct().collect()}
        assert len(folders) <= hours + 1
    plan = plan_of(in_window(conn, "1h", NOW_MS), capsys)
    assert "PartitionFilters: [" in plan and "hour" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters: [" in plan and "ingest_time" in plan.split("PushedFilters: [")[1].split("\n")[0]
    assert in_hours(conn, NOW_MS - 5 * HOUR, NOW_MS - 4 * HOUR).count() == conn.filter(f"ingest_time >= {NOW_MS - 5 * HOUR} AND ingest_time < {NOW_MS - 4 * HOUR}").count()


def test_times_in_seconds_stay_in_windows(spark, tmp_path):
    """A writer of seconds puts its rows in folders of 1970; windows still find them."""
    rows = spark.createDataFrame([("conn", NOW_MS // 1000 - 60, "a"), ("conn", NOW_MS - 60_000, "b"), ("conn", NOW_MS - 8 * 24 * HOUR, "c")], "log_type string, ingest_time long, flow_id string")
    files.write_lake(rows, str(tmp_path / "lake"))
    conn = files.open_lake(spark, str(tmp_path / "lake"), ("conn",), views=False)["conn"]
    assert {r["flow_id"] for r in in_window(conn, "1h", NOW_MS).collect()} == {"a", "b"}


def test_refreshes_read_new_hours_alone(spark, base, tmp_path):
    """The second refresh runs on a lake that holds nothing older; dashboards equal the bundle over everything."""
    log = rollup.dashboard_log(str(tmp_path / "counts"))
    cut = NOW_MS - 24 * HOUR
    lake = opened(spark, base)
    rollup.refresh_dashboards(lake, log, None, cut)
    newer = str(tmp_path / "newer")
    for folder in Path(base).rglob("hour=*"):
        y, m, d, h = (int(folder.parts[i].split("=")[1]) for i in (-4, -3, -2, -1))
        if (y, m, d) >= (2024, 1, 30):  # the last day
            shutil.copytree(folder, Path(newer) / folder.relative_to(base))
    for _ in range(2):  # again
        rollup.refresh_dashboards(opened(spark, newer), log, cut, NOW_MS)
    windows = ("24h", "7d", "all")
    found = rollup.dashboards(spark, log, windows, NOW_MS)
    wanted = logs.lake_bundle(lake, windows, NOW_MS)
    assert sorted(map(tuple, found.select(*wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))
    assert {r["widget"] for r in found.collect()} >= {"events", "alert_hour", "protocol"}
    assert rollup.dashboards(spark, rollup.dashboard_log(str(tmp_path / "none")), windows, NOW_MS).count() == 0


def test_rolling_baselines_equal_one_pass(spark, tmp_path):
    """Moments kept by hour and rolled over a day, against all numbers of that day at once; large numbers lose nothing."""
    rng = random.Random(12)
    rows = [(f"h{rng.randrange(12)}", rng.choice(["a", "a", "b", None]), NOW_MS - rng.randrange(48 * HOUR), rng.choice([1e9 + rng.random(), None])) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "host string, grp string, event_time long, x double")
    log = rollup.baseline_log(str(tmp_path / "moments"))
    steps = [None, NOW_MS - 30 * HOUR, NOW_MS - 10 * HOUR, NOW_MS - HOUR]
    for since, until in zip(steps, [*steps[1:], NOW_MS]):
        rollup.refresh_baselines(frame, log, "host", "grp", "x", since, until)
    rollup.refresh_baselines(frame, log, "host", "grp", "x", NOW_MS - HOUR, NOW_MS)  # again
    own, groups = rollup.baselines(spark, log, NOW_MS)
    last = frame.filter(f"event_time >= {NOW_MS - 24 * HOUR} AND x IS NOT NULL")
    wanted = {(r["host"], r["grp"]): r for r in last.groupBy("host", "grp").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()}
    found = {(r["asset"], r["peers"]): r for r in own.collect()}
    assert set(found) == set(wanted)
    for k, r in found.items():
        assert r["n"] == wanted[k]["n"] and abs(r["mean"] - wanted[k]["m"]) < 1e-5 and abs(r["std"] - wanted[k]["s"]) < 1e-5
    blended = {r["peers"]: r for r in rollup.baselines(spark, log, NOW_MS, seed=(1e9, 1.0))[1].collect()}
    for r in groups.filter("peers IS NOT NULL").collect():
        assert r["assets"] >= 5 and abs(blended[r["peers"]]["std"] - (0.7 * r["std"] + 0.3)) < 1e-9
    scored = rollup.scored(last, own, groups, "host", "grp", "x").collect()
    assert len(scored) == last.count() and all(r["zscore_asset"] is not None for r in scored)


def test_one_job_runs_again_after_a_failure(spark, sf, tmp_path):
    """A sink that fails between two others; the batch runs again, and every output has each row once."""
    conn = fixtures.table(spark, sf, "conn").limit(400)
    folder = str(tmp_path / "in")
    for k in range(2):
        catalog._messages(conn.filter(f"src_port % 2 = {k}")).coalesce(1).write.mode("append").parquet(folder)
    lake, records, letters = (str(tmp_path / n) for n in ("lake", "records", "letters"))
    failed = []

    def flat(rows, number):
        enrich.to_folder(records)(rows, number)
        if number == 1 and not failed:
            failed.append(number)
            raise OSError("no more space")

    bindings = identity.dhcp_bindings(fixtures.table(spark, sf, "dhcp"))
    found = identity.mac_assets(bindings)
    context = enrich.Context(bindings, identity.asset_ids(found), spark.createDataFrame([("AST-0001", "server")], "asset_id string, asset_type string"), spark.createDataFrame([("10.0.0.1",)], "ip string"))
    job = enrich.enrich_job(lake, flat, enrich.to_folder(letters), lambda: context)

    def run():
        stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).parquet(folder)
        stream.writeStream.foreachBatch(job).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="no more space"):
        run()
    run()
    assert failed == [1]
    good = conn.filter("src_port % 10 < 8").count()
    flat_rows = spark.read.parquet(records)
    assert flat_rows.count() == good == files.open_lake(spark, lake, views=False)["conn"].count()
    assert spark.read.parquet(letters).count() == 400 - good
    assert flat_rows.filter("asset_id <> ''").count() > 0 and flat_rows.filter("src_is_blacklisted").count() == conn.filter("src_port % 10 < 8 AND src_ip = '10.0.0.1'").count()
    whole = files.open_lake(spark, lake, views=False)
    assert set(whole) == {"conn"} and set(whole["conn"].columns) >= {"flow_id", "conn_state", "direction"} and "conn" in schemas.LOG_TYPES


def test_fan_out_and_stream_to_lake(spark, sf, tmp_path):
    from wirelake.streaming import jobs

    rows = fixtures.table(spark, sf, "dns").limit(300).withColumns({"log_type": F.lit("dns"), "ingest_time": F.col("event_time"), "ftx_id": F.col("flow_id")})
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    jobs.stream_to_lake(stream(), str(tmp_path / "lake"), str(tmp_path / "cp1"), available_now=True).awaitTermination()
    assert files.open_lake(spark, str(tmp_path / "lake"), ("dns",), views=False)["dns"].count() == 300
    sinks = [enrich.to_folder(str(tmp_path / "a")), lambda df, n: enrich.to_folder(str(tmp_path / "b"))(files.kafka_records(df), n)]
    files.fan_out(stream(), sinks, str(tmp_path / "cp2"), available_now=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "a")).count() == spark.read.parquet(str(tmp_path / "b")).count() == 300
