"""One entity with most rows: scans in blocks of time give what a loop over all its rows gives."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wirelake.operators import detections, identity


def rows_of(seed, n=600, step=900_000):
    """Mostly one entity; equal times, long silences, null entities."""
    rng = random.Random(seed)
    t, out = 1_700_000_000_000, []
    for i in range(n):
        t += rng.choice([0, 1000, step // 3, step, step * rng.randrange(1, 20)])
        out.append((i, rng.choice(["hot"] * 6 + ["cold", None]), rng.choice("ABC"), t, rng.choice([20, 40, 60])))
    return out


def by_entity(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        found.setdefault(r[1], []).append(r)
    return found


KIND = "id long, asset_id string, signal_id string, event_time long, points int"


@pytest.mark.parametrize("block_ms", [1000, 3_600_000, 86_400_000_000])
def test_ledger_and_decay(spark, block_ms):
    rows = rows_of(block_ms % 97)
    frame = spark.createDataFrame(rows, KIND)
    ledger = {r["id"]: r["running_total"] for r in detections.risk_ledger(frame, block_ms=block_ms).collect()}
    risk = {r["id"]: r["risk"] for r in detections.risk_decay(frame, block_ms=block_ms).collect()}
    assert len(ledger) == len(risk) == len(rows)
    for own in by_entity(rows).values():
        total = 0
        for r, wanted in zip(own, detections.decayed([r[3] for r in own], [r[4] for r in own])):
            total += r[4]
            assert ledger[r[0]] == total and risk[r[0]] == wanted


def test_dedup(spark):
    rows = rows_of(5, step=240_000)
    frame = spark.createDataFrame(rows, KIND)
    kept = set()
    for entity, own in by_entity(rows).items():
        for signal in "ABC":
            pair = [r for r in own if r[2] == signal]
            kept |= {r[0] for r, ok in zip(pair, detections.kept_alerts([r[3] for r in pair], 300_000, 900_000)) if ok}
    assert {r["id"] for r in detections.dedup_alerts(frame, per_hour=1000).collect()} == kept
    again = frame.withColumns({"_last": F.lit(1), "note": F.lit("x")}).drop("_last")
    assert {r["id"] for r in detections.dedup_alerts(again, per_hour=1000).collect()} == kept


def test_dense_pairs_leave_few_rows_to_the_walk(spark):
    """Ten alerts a second of one pair for an hour: columns alone leave the first."""
    frame = spark.range(36_000).select("id", F.lit("hot").alias("asset_id"), F.lit("A").alias("signal_id"), (F.lit(1_700_000_000_000) + F.col("id") * 100).alias("event_time"))
    assert [r["id"] for r in detections.dedup_alerts(frame).collect()] == [0]


def chains(rows, stages, within):
    """From each first stage the earliest ending chain of later signals, stage by stage from the end."""
    out = []
    for entity, own in by_entity(rows).items():
        best = [None] * len(own)  # (end, ids, times) of the chain that begins at a row with stage j
        for j in range(len(stages) - 1, -1, -1):
            now, least = [None] * len(own), None
            for i in range(len(own) - 1, -1, -1):
                r = own[i]
                if r[2] == stages[j]:
                    if j == len(stages) - 1:
                        now[i] = (r[3], [r[0]], [r[3]])
                    elif least:
                        now[i] = (least[0], [r[0], *least[1]], [r[3], *least[2]])
                if best[i] and (least is None or best[i] < least):
                    least = best[i]
            best = now
        out += [(entity, r[3], b[0], ",".join(map(str, b[1]))) for r, b in zip(own, best) if b and b[0] - r[3] <= within]
    return out


@pytest.mark.parametrize("stages", [("A", "B"), ("A", "B", "C"), ("A", "A")])
def test_correlation(spark, stages):
    rows = rows_of(9, step=400_000)
    found = detections.correlate_use_case(spark.createDataFrame(rows, KIND), stages, 3_600_000).collect()
    key = lambda x: tuple(map(str, x))
    assert found and sorted((tuple(r)[:4] for r in found), key=key) == sorted(chains(rows, stages, 3_600_000), key=key)
    r = found[0]
    assert r["kill_chain"].startswith(f'[{{"signal_id":"{stages[0]}","time":{r["start_time"]}}}') and r["kill_chain"].endswith(f'"time":{r["end_time"]}}}]')


def test_correlation_is_not_quadratic(spark):
    """Forty thousand signals of one asset within one window."""
    frame = spark.range(40_000).select("id", F.lit("hot").alias("asset_id"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("signal_id"), (F.lit(1_700_000_000_000) + F.col("id")).alias("event_time"))
    assert detections.correlate_use_case(frame, ("A", "B")).count() == 20_000


@pytest.fixture
def lake(spark):
    rng = random.Random(4)
    t0 = 1_700_000_000_000
    bindings = [(t0 + rng.randrange(9 * 86_400_000), rng.choice("PQRST"), rng.choice(["10.0.0.1", "10.0.0.1", "10.0.0.2", "10.0.0.3"]), "n", 3600) for _ in range(200)]
    bindings += [(bindings[0][0], "Z", bindings[0][2], "n", 3600)]
    events = [(i, rng.choice(["10.0.0.1"] * 5 + ["10.0.0.2", "8.8.8.8", "", None]), t0 + rng.randrange(10 * 86_400_000), "x") for i in range(1500)]
    events += [(2000, bindings[0][2], bindings[0][0], "x")]  # at the very time
    return spark.createDataFrame(events, "id long, src_ip string, event_time long, _held string"), spark.createDataFrame(bindings, "event_time long, mac string, ip string, hostname string, lease_s int"), events, bindings


def test_resolution_ways_agree(lake):
    events, bindings, plain_events, plain_bindings = lake
    wanted = {}
    for i, ip, t, _ in plain_events:
        held = [(b[0], b[1]) for b in plain_bindings if b[2] == ip and b[0] <= t]
        wanted[i] = max(held)[1] if held else None
    frame = events.drop("_held")
    for few in (identity.FEW, 10, 2):  # lists; windows of addresses with bindings; windows of all
        found = identity.resolve_ip(frame, bindings, few=few)
        assert found.columns == [*frame.columns, "mac"] and {r["id"]: r["mac"] for r in found.collect()} == wanted
    assert identity.resolve_ip(frame, bindings.limit(0)).filter("mac IS NOT NULL").count() == 0


def test_few_bindings_move_no_event(lake, capsys):
    events, bindings, *_ = lake
    identity.resolve_ip(events.drop("_held"), bindings).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    probe = plan.split("BroadcastExchange")[0]
    assert "Exchange" not in probe
