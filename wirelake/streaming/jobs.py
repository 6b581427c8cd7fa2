"""The log jobs as Structured Streaming: the same column functions over streams, with event time and watermarks.

A batch result equals the stream's for rows in time order; rows behind the watermark are dropped.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelake import schemas
from wirelake.functions import scalars as S
from wirelake.operators import assets, identity, normalize

WATERMARK = "10 minutes"


def with_event_time(df: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Adds ts from event_time (ms) as the event-time column."""
    return df.withColumn("ts", F.timestamp_millis("event_time")).withWatermark("ts", delay)


def stream_normalize(messages: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(enriched flat records, dead letters) of a stream of raw messages; stateless, append."""
    good, bad = normalize.split_dead_letters(normalize.parse_envelope(messages, value), value)
    return normalize.to_stream_record(good), bad


def stream_to_lake(rows: DataFrame, base: str, checkpoint: str, available_now: bool = False):
    """Append to the partitioned lake every few seconds; files.compact_hours makes few files of the hours that are past.

    rows: with log_type and ingest_time in ms.
    """
    ts = F.timestamp_millis("ingest_time")
    parts = {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH"}
    writer = rows.withColumns({n: F.date_format(ts, f) for n, f in parts.items()}).writeStream.format("parquet").partitionBy("log_type", *parts).option("path", base).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def stream_profiles(lake: dict[str, DataFrame], ttl: str | None = None) -> DataFrame:
    """Counters of each address; update mode.

    With a ttl: per tumbling window of that length, in append mode, so that state goes once the watermark has passed a window;
    profile_log.ProfileLog sums them up. Without one, state holds every address for good.
    """
    rows = assets.sides(lake)
    if ttl is None:
        return assets.counters(rows)
    return assets.counters(with_event_time(rows), F.window("ts", ttl))


_BOUND = "_ip string, _event string, mac string"
_HELD = T.StructType([T.StructField("bound", T.BinaryType()), T.StructField("firsts", T.ArrayType(T.LongType())), T.StructField("packs", T.ArrayType(T.BinaryType()))])
#: Waiting events that are deflated together, in order of time.
PACK = 2000


def _pack(held: list[tuple[int, str | None]]) -> bytes:
    return zlib.compress(json.dumps(held).encode(), 1)


def _unpack(pack: bytes) -> list[list]:
    return json.loads(zlib.decompress(pack))


def stream_identity(events: DataFrame, bindings: DataFrame, ip: str = "src_ip", delay: str = WATERMARK, salts: int = 8) -> DataFrame:
    """A stream of events with mac, resolved by a stream of bindings (as dhcp_bindings gives): what resolve_ip gives in batch.

    State of an address: its bindings and the events that wait. An event waits until the watermark has passed its time,
    so bindings that come late by up to the delay still count for it; a timer at the earliest one lets them go. Of the
    bindings behind the watermark only the last is kept, so state is one binding and what the delay holds. An
    address's events are dealt over so many salts, each with all of its bindings, so that a busy address is several tasks.
    Bindings and waiting events are held deflated, as Python gathers the state of all of a task's addresses, and events go out pack by pack.
    Events without an address go by at once.
    """
    names = events.columns
    form = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
    known = events.filter(F.col(ip).isNotNull())
    salt = F.pmod(F.xxhash64(*(n for n, k in events.dtypes if k != "variant" and not k.startswith("map"))), F.lit(salts)).cast("int")
    left = known.select(F.col(ip).alias("_ip"), salt.alias("_salt"), F.col("event_time").cast("long").alias("event_time"), F.lit(None).cast("string").alias("_mac"), F.to_json(F.struct(*names), form).alias("_event"))
    right = bindings.filter("mac IS NOT NULL AND ip IS NOT NULL").select(F.col("ip").alias("_ip"), F.explode(F.array(*map(F.lit, range(salts)))).alias("_salt"), F.col("event_time").cast("long").alias("event_time"), F.col("mac").alias("_mac"), F.lit(None).cast("string").alias("_event"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        told, firsts, packs = state.get if state.exists else (_pack([]), [], [])
        bound, firsts, packs = [(t, mac) for t, mac in _unpack(told)], list(firsts), list(packs)
        open_: list[tuple[int, str]] = []

        def close(least: int) -> None:
            while len(open_) >= least:
                part = sorted(open_[:PACK])
                del open_[:PACK]
                firsts.append(part[0][0])
                packs.append(_pack(part))

        for rows in [] if state.hasTimedOut else batches:
            for t, mac, event in zip(rows["event_time"].tolist(), rows["_mac"].tolist(), rows["_event"].tolist(), strict=True):
                if event is None:
                    bound.append((int(t), mac))
                else:
                    open_.append((int(t), event))
            close(PACK)
        close(1)
        bound.sort()
        passed = state.getCurrentWatermarkMs()
        due = [i for i, first in enumerate(firsts) if first <= passed]
        ready = [packs[i] for i in due]
        kept = [i for i, first in enumerate(firsts) if first > passed]
        firsts, packs = [firsts[i] for i in kept], [packs[i] for i in kept]
        for pack in ready:
            out = []
            for t, event in _unpack(pack):
                if t <= passed:
                    k = bisect.bisect_right(bound, t, key=lambda x: x[0])
                    out.append((key[0], event, bound[k - 1][1] if k else None))
                else:
                    open_.append((t, event))
            close(PACK)
            yield pd.DataFrame(out, columns=["_ip", "_event", "mac"], dtype=object)
        close(1)
        bound = bound[max(0, bisect.bisect_right(bound, passed, key=lambda x: x[0]) - 1) :]
        if bound or packs:
            state.update((_pack(bound), firsts, packs))
            if packs:
                state.setTimeoutTimestamp(min(firsts))
        elif state.exists:
            state.remove()

    both = with_event_time(left.unionByName(right), delay)
    found = both.groupBy("_ip", "_salt").applyInPandasWithState(step, _BOUND, _HELD, "append", "EventTimeTimeout")
    row = F.from_json("_event", events.schema, {"timestampFormat": form["timestampFormat"]})
    resolved = found.withColumn("_row", row).select(*(F.col("_row")[n].alias(n) for n in names), "mac")
    return resolved.unionByName(events.filter(F.col(ip).isNull()).withColumn("mac", F.lit(None).cast("string")))


def batch_identity(bindings: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over events: resolves them by a table of bindings and writes them below path.

    A batch has a folder of its own, so a batch that is run again replaces its rows.
    """

    def resolve(batch: DataFrame, number: int) -> None:
        identity.resolve_ip(batch, bindings).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return resolve


def stream_metrics(rows: DataFrame) -> DataFrame:
    """Per minute and log type: events, their latency percentile, and a count for each latency bucket.

    rows: with event_time, ingest_time, log_type.
    """
    late = F.col("ingest_time") - F.col("event_time")
    buckets = [F.count_if(S.latency_bucket(late) == bound).alias(f"le_{bound}") for bound in S.LATENCY_MS]
    return with_event_time(rows).groupBy(F.window("ts", "1 minute"), "log_type").agg(F.count(F.lit(1)).alias("events"), F.percentile_approx(late, 0.95).alias("p95_ms"), *buckets, F.count_if(late > S.LATENCY_MS[-1]).alias("slow"))


def stream_outcomes(parsed: DataFrame) -> DataFrame:
    """Per minute of arrival: messages consumed, enriched, and dead letters by kind. parsed: from parse_envelope, with arrival (ms)."""
    known = F.col("sound") & F.coalesce(F.col("log_type").isin(*schemas.LOG_TYPES), F.lit(False))
    rows = parsed.withColumn("ts", F.timestamp_millis("arrival")).withWatermark("ts", WATERMARK)
    return rows.groupBy(F.window("ts", "1 minute")).agg(F.count(F.lit(1)).alias("consumed"), F.count_if(known).alias("enriched"), F.count_if(~F.col("sound")).alias("parse_errors"), F.count_if(F.col("sound") & ~known).alias("dead_letters"))


def stream_latency_rule(rows: DataFrame, bound_ms: int = 5000, length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Sliding windows in which the 95th percentile of latency is over its bound."""
    late = F.col("ingest_time") - F.col("event_time")
    found = with_event_time(rows).groupBy(F.window("ts", length, slide)).agg(F.percentile_approx(late, 0.95).alias("p95_ms"))
    return found.filter(F.col("p95_ms") > bound_ms).select(F.unix_millis("window.start").alias("window_start"), "p95_ms")


def stream_alert_rules(metrics: DataFrame, name: str, least: int, length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Sliding windows in which a counter went over its bound. metrics: event_time, metric, value."""
    rows = with_event_time(metrics.filter(F.col("metric") == name))
    sums = rows.groupBy(F.window("ts", length, slide)).agg(F.sum("value").alias("value"))
    return sums.filter(F.col("value") > least).select(F.lit(name).alias("metric"), F.unix_millis("window.start").alias("window_start"), "value")


def stream_threshold_signals(rows: DataFrame, entity: str, predicate: str, least: int, length: str = "5 minutes") -> DataFrame:
    """Entities with so many matching rows in a tumbling window; append mode, late rows dropped."""
    counts = with_event_time(rows.filter(predicate)).groupBy(F.window("ts", length), F.col(entity).alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= least).select("entity", F.unix_millis("window.start").alias("window_start"), "n")


def stream_dedup(alerts: DataFrame, within: str = "5 minutes") -> DataFrame:
    """One alert of each signal and asset within the time."""
    return with_event_time(alerts, within).dropDuplicatesWithinWatermark(["signal_id", "asset_id"])


def stream_lookup(rows: DataFrame, reference: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Stream with a static set, which the planner broadcasts if it is small."""
    return rows.join(reference, key, how)


def stream_sessions(rows: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Host activity sessions by inactivity; append mode."""
    counts = with_event_time(rows).groupBy("src_ip", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("src_ip", F.unix_millis("s.start").alias("session_start"), "n")


CORRELATED = T.StructType([T.StructField("asset_id", T.StringType()), T.StructField("start_time", T.LongType()), T.StructField("end_time", T.LongType())])
_STATE = T.StructType([T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("stages", T.ArrayType(T.LongType()))])


def stream_correlation(signals: DataFrame, stages: tuple[str, ...], within_ms: int = 3_600_000) -> DataFrame:
    """Per entity: stages in order within the time, as they complete; the chains of detections.correlate_use_case.

    State holds the open chains, each its start and the stages it has met: a signal moves every chain that waits
    for it. Chains older than the time go, so an entity's state is bounded by its first stages within that time;
    all of it expires by event time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        chains = [list(x) for x in zip(*state.get, strict=True)] if state.exists else []
        out, last = [], 0
        rows = pd.concat(list(batches)).sort_values(["event_time", "id"], kind="stable")
        for signal, t in zip(rows["signal_id"], rows["event_time"].astype(int).tolist(), strict=True):
            last = max(last, t)
            chains = [x for x in chains if t - x[0] <= within_ms]
            for chain in chains:
                chain[1] += stages[chain[1]] == signal
            out += [(key[0], start, t) for start, met in chains if met == len(stages)]
            chains = [x for x in chains if x[1] < len(stages)]
            if signal == stages[0]:
                chains.append([t, 1])
        state.update(([x[0] for x in chains], [int(x[1]) for x in chains]))
        state.setTimeoutTimestamp(max(last + within_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[f.name for f in CORRELATED])

    rows = with_event_time(signals.filter(F.col("signal_id").isin(*stages)).select("asset_id", "signal_id", "id", "event_time"))
    return rows.groupBy("asset_id").applyInPandasWithState(step, CORRELATED, _STATE, "append", "EventTimeTimeout")
