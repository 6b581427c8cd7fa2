"""Findings of round 4, each on rows that gave a cut result or moved too much before."""

from __future__ import annotations

import re
import time

import duckdb
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from wirelake.operators import identity, normalize
from wirelake.plans import catalog
from wirelake.sources import files
from wirelake.streaming import enrich


def test_alert_activity_by_asset_takes_all_signals(spark, sf, tmp_path):
    """An alert without log ids gets all signals of its signal_id and asset, however many newer ones there are."""
    events = f"SELECT * EXCLUDE (range) REPLACE (CAST(range AS BIGINT) AS event_id, CAST(7 AS BIGINT) AS user_id) FROM (SELECT * FROM '{sf}/events.parquet' LIMIT 1) CROSS JOIN range(1500)"
    # an alert at the time of each signal, the oldest ones among them
    orders = f"SELECT * REPLACE (CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(7 AS BIGINT) AS o_custkey, 'O' AS o_orderstatus) FROM '{sf}/orders.parquet'"
    duckdb.sql(events).write_parquet(str(tmp_path / "events.parquet"))
    duckdb.sql(orders).write_parquet(str(tmp_path / "orders.parquet"))
    for name in ("events", "orders"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    found = sorted(map(tuple, catalog.QUERIES["alert_activity_by_asset"](spark, str(tmp_path)).collect()))
    assert found == sorted(duckdb.sql(catalog.SQL["alert_activity_by_asset"]).fetchall())
    pairs = duckdb.sql("SELECT count(*) FROM orders, range(1500) WHERE abs((o_orderkey * 104729) % 2592000 - (range * 7919) % 2592000) <= 900").fetchall()[0][0]
    assert sum(r[2] for r in found) == pairs


def _codecs(folder) -> set[str]:
    metadata = [pq.ParquetFile(f).metadata for f in folder.rglob("*.parquet")]
    return {m.row_group(i).column(0).compression for m in metadata for i in range(m.num_row_groups)}


def test_lake_is_dealt_as_messages(spark, tmp_path):
    """Only messages move; a message whose first ts is not its own, or in no plain notation, lies in its own hour all the same."""
    times = ["1704067200.5", "1.7040708E9", '"2024-01-01T02:30:00Z"', '"2024-01-01 03:30:00"', '"1704081600"', '"soon"']
    rows = [f'{{"conn":{{"ts":{t},"uid":"C{i}"}}}}' for i, t in enumerate(times)]
    rows += ['{"extra":[{"ts":9}],"_path":"conn","ts":1704085200,"uid":"C6"}', '{"_path":"conn","\\u0074s":1704088800,"uid":"C7"}', '{"_path":"dns","ts":1704067200,"uid":"D0"}']
    good, _ = normalize.split_dead_letters(normalize.parse_envelope(spark.createDataFrame([(r,) for r in rows], "value string")))
    enrich.write_tables(good, 0, str(tmp_path))
    lake = files.open_lake(spark, str(tmp_path), views=False)
    assert lake["dns"].count() == 1
    hours = {r["flow_id"]: (r["year"], r["hour"], r["event_time"] // 3_600_000 % 24) for r in lake["conn"].collect()}
    assert hours == {f"C{i}": (2024, i, i) for i in range(5)} | {"C5": (1970, 0, 0), "C6": (2024, 5, 5), "C7": (2024, 6, 6)}
    assert _codecs(tmp_path) == {"ZSTD"}
    plan = re.sub(r"#\d+L?", "", enrich.table_rows(good, "conn")._jdf.queryExecution().optimizedPlan().toString()).splitlines()
    at = next(i for i, line in enumerate(plan) if "RepartitionByExpression" in line)
    assert sum("Repartition" in line for line in plan) == 1 and "Project [" in plan[at + 1] and "struct" not in plan[at + 1] and plan[at + 1].count(", ") <= 2


def test_enrichment_moves_messages_for_the_lookup(spark, tmp_path, monkeypatch):
    """With bindings too many to be broadcast, what moves is the message; the record is made of it once, afterwards."""
    message = lambda i, ip, t, nested: (f'{{"conn":{{"ts":{t},"uid":"C{i}","id.orig_h":{ip},"conn_state":"SF"}}}}' if nested else f'{{"_path":"conn","ts":{t},"uid":"C{i}","id.orig_h":{ip},"conn_state":"SF"}}')
    asked = [('"10.0.0.1"', "5"), ('"10.0.0.1"', "15.5"), ('"10.0.0.1"', '"1970-01-01T00:00:25Z"'), ('" 10.0.0.2"', "5"), ('"10.0.0.3"', "5"), ("null", "5"), ("7", "1.5E1"), ('"8.8.8.8"', "15")]
    batch = spark.createDataFrame([(message(i, ip, t, i % 2 == 0),) for i, (ip, t) in enumerate(asked)] + [("{broken",)], "value string")
    bindings = spark.createDataFrame([("10.0.0.1", 10_000, "M1"), ("10.0.0.1", 20_000, "M9"), ("8.8.8.8", 1, "M1")], "ip string, event_time long, mac string")
    ids = spark.createDataFrame([("M1", None, "A1"), (None, "10.0.0.1", "A2"), (None, "10.0.0.2", "A3")], "mac string, ip string, asset_id string")
    types = spark.createDataFrame([("A1", "server"), ("A3", "iot")], "asset_id string, asset_type string")
    threats = spark.createDataFrame([("10.0.0.1",)], "ip string")
    context = enrich.Context(bindings, ids, types, threats)
    held = []
    job = enrich.enrich_job(str(tmp_path / "lake"), lambda rows, number: held.append(rows), enrich.to_folder(str(tmp_path / "letters")), lambda: context)
    job(batch, 0)
    find = identity.resolve_ip
    monkeypatch.setattr(identity, "resolve_ip", lambda events, bindings, ip="src_ip": find(events, bindings, ip, few=1))
    job(batch, 1)
    few, many = (sorted(map(tuple, rows.select(*rows.columns[:-2], F.element_at("details", "conn_state"), "event_time").collect()), key=lambda r: r[2]) for rows in held)
    assert few == many and held[0].columns == normalize.to_stream_record(normalize.parse_envelope(batch)).columns
    found = {r["uid"]: (r["asset_id"], r["asset_type"], r["src_is_blacklisted"], r["event_time"], r["src_ip"]) for r in held[1].collect()}
    assert found == {
        "C0": ("A2", "", True, 5000, "10.0.0.1"), "C1": ("A1", "server", True, 15500, "10.0.0.1"), "C2": ("", "", True, 25000, "10.0.0.1"), "C3": ("A3", "iot", False, 5000, " 10.0.0.2"),
        "C4": ("", "", False, 5000, "10.0.0.3"), "C5": ("", "", False, 5000, None), "C6": ("", "", False, 15000, None), "C7": ("", "", False, 15000, "8.8.8.8"),
    }
    key = "spark.sql.debug.maxToStringFields"
    shown = spark.conf.get(key)
    spark.conf.set(key, "1000")
    try:
        plan = held[1]._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(key, shown)
    assert plan.count("sha2(") == 1 and plan.index("sha2(") < plan.index("_held#")
    rows = held[1].limit(3)
    enrich.to_folder(str(tmp_path / "records"))(rows, 0)
    assert _codecs(tmp_path / "records") == _codecs(tmp_path / "letters") == {"ZSTD"}


def test_enrichment_frees_what_it_shuffled(spark, tmp_path):
    """What one output of a batch shuffled is gone from the disk before the next output is asked for."""
    held = lambda: {b for b in re.findall(r"shuffle_\d+", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().toString())}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    batch = spark.range(500).selectExpr("""concat('{"conn":{"ts":', 1704067200 + 60 * id, ',"uid":"C', id, '"}}') AS value""")
    before, left, setting = held(), [], spark.conf.get(key, None)

    def sink(rows, number):
        until = time.monotonic() + 10  # files go in the background
        while held() - before and time.monotonic() < until:
            time.sleep(0.2)
        left.append(held() - before)
        assert rows.repartition(3).count() == (500 if "uid" in rows.columns else 0)

    enrich.enrich_job(str(tmp_path / "lake"), sink, sink)(batch, 0)
    assert left == [set(), set()] and spark.conf.get(key, None) == setting
    assert files.open_lake(spark, str(tmp_path / "lake"), ("conn",), views=False)["conn"].count() == 500
