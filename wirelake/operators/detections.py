"""Alerts, signals and risk: lists, drill-downs, ledgers, suppression, correlation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake.functions import scalars as S
from wirelake.functions.scalars import escape_like
from wirelake.operators.common import BLOCK_MS, in_blocks, page, top, with_block_facts, with_last_time

SEVERITIES = ("critical", "high", "medium", "low")
# Points of a signal by its method.
POINTS = {"rule": 20, "zscore": 40, "hybrid": 60, "ml": 80}
HIDDEN_BELOW = 20
DECAY_POINTS, DECAY_MS = 20, 600_000


def list_alerts(alerts: DataFrame, alert_type: str | None = None, severities: tuple[str, ...] = (), statuses: tuple[str, ...] = (), text: str = "", category: str = "", tactic: str = "", low_ms: int | None = None, high_ms: int | None = None, number: int = 1, size: int = 50) -> DataFrame:
    """One page, newest first, then by falling id. Text looks into name and asset; category ignores case."""
    rows = alerts
    if alert_type:
        rows = rows.filter(F.col("alert_type") == alert_type)
    if severities:
        rows = rows.filter(F.col("severity").isin(*severities))
    if statuses:
        rows = rows.filter(F.col("status").isin(*statuses))
    if text:
        like = f"%{escape_like(text)}%"
        rows = rows.filter(F.col("name").ilike(like) | F.col("asset_id").ilike(like))
    if category:
        rows = rows.filter(F.lower("category") == category.lower())
    if tactic:
        rows = rows.filter(F.col("mitre_tactic").ilike(f"%{escape_like(tactic)}%"))
    if low_ms is not None:
        rows = rows.filter(F.col("event_time") >= low_ms)
    if high_ms is not None:
        rows = rows.filter(F.col("event_time") <= high_ms)
    return page(rows.orderBy(F.desc("event_time"), F.desc("id")), number, size)


def list_incidents(alerts: DataFrame, **filters) -> DataFrame:
    return list_alerts(alerts, alert_type="use_case", **filters)


def list_anomalies(signals: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    return page(signals.filter("visibility_mode = 'anomaly'").orderBy(F.desc("event_time"), F.desc("id")), number, size)


def severity_summary(alerts: DataFrame) -> DataFrame:
    """Four severities, zero filled."""
    listed = alerts.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"('{s}')" for s in SEVERITIES) + " AS t(severity)")
    counts = alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return listed.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def enrich_alerts(alerts: DataFrame, assets: DataFrame, signals: DataFrame) -> DataFrame:
    """assets: asset_id and more; signals: signal_id and more; one row for each id."""
    return alerts.join(assets, "asset_id", "left").join(signals, "signal_id", "left")


def expand_signals(alerts: DataFrame) -> DataFrame:
    """A row for each contributing signal: stage (from 1), signal, title, evidence.

    contributing_signals is a JSON list of ids or of objects; an alert without one has a single stage, itself.
    """
    ids = F.from_json("contributing_signals", "array<string>")
    rows = alerts.select("id", "signal_id", "name", F.when(F.size(ids) > 0, ids).otherwise(F.array(F.lit(None).cast("string"))).alias("items"))
    rows = rows.select("id", "signal_id", "name", F.posexplode("items").alias("pos", "item"))
    one = F.from_json("item", "signal_id string, title string, evidence string")
    is_object = F.col("item").startswith("{")
    return rows.select(
        "id", (F.col("pos") + 1).alias("stage"),
        F.when(is_object, one["signal_id"]).otherwise(F.coalesce("item", "signal_id")).alias("signal_id"),
        F.when(is_object, one["title"]).otherwise(F.coalesce("item", "name")).alias("title"),
        F.when(is_object, one["evidence"]).alias("evidence"),
    )


def signal_evidence_ids(signals: DataFrame, n: int = 5) -> DataFrame:
    """The latest n signal ids of each (signal, asset), as comma separated text, newest first."""
    rank = F.row_number().over(Window.partitionBy("signal_id", "asset_id").orderBy(F.desc("event_time"), F.desc("id")))
    rows = signals.select("signal_id", "asset_id", "id", "event_time").withColumn("rank", rank).filter(F.col("rank") <= n)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string"))
    return rows.groupBy("signal_id", "asset_id").agg(F.array_join(ids, ",").alias("ids"))


def contributing_logs(signals: DataFrame, wanted: DataFrame) -> DataFrame:
    """Signals that list any wanted id (column ftx_id), each once: by equality on exploded ids."""
    ids = signals.select("id", F.explode(F.array_distinct(F.split("ftx_ids", ","))).alias("ftx_id"))
    hits = ids.join(wanted.select("ftx_id").distinct(), "ftx_id", "left_semi").select(F.col("id").alias("hit")).distinct()
    return signals.join(hits, F.col("id") == F.col("hit"), "left_semi")


def alert_activity(alerts: DataFrame, signals: DataFrame, within_ms: int = 900_000, newest: int | None = 1000) -> DataFrame:
    """Per alert and minute: events, bytes in and out and peers of its signals within so much time of it.

    Signals are those that share a log id with the alert, joined by equality; for alerts without any such signal
    at any time, those of the alert's signal_id and asset: so many newest ones as a page shows, or all (None), as the
    registered queries ask. Empty log ids, names and peers match nothing.
    Alerts of the same time that ask for the same signals are answered once (_ask), and an answer has a row for each
    minute alone when it comes back to its alerts; so pairs of questions and signals move once, and those of alerts never.
    """
    ids = F.array_sort(F.array_distinct(F.filter(F.transform(F.split("ftx_ids", ","), lambda x: F.trim(x)), lambda x: x != "")))
    again = alerts.groupBy(F.col("id").alias("_again")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    asking = alerts.select(F.col("id").alias("alert_id"), F.col("event_time").alias("alert_time"), "signal_id", "asset_id", ids.alias("_ids"))
    asking = asking.join(again, F.col("alert_id").eqNullSafe(F.col("_again")), "left")
    # an id that several alerts have asks as one, so that a signal of two of them still counts once
    own = F.when(F.col("_n").isNotNull(), F.when(F.col("alert_id").isNull(), "n").otherwise(F.concat(F.lit("a"), F.col("alert_id").cast("string"))))
    at = F.concat(F.lit("t"), F.col("alert_time").cast("string"), F.lit(" "))
    asking = asking.withColumn("_ask", F.coalesce(own, F.concat(at, F.coalesce(F.array_join("_ids", ","), F.lit("")))))
    pick = lambda *names: F.coalesce(*(F.get_json_object("evidence", f"$.features.{n}").try_cast("long") for n in names), F.lit(0))
    bucket = lambda c: F.floor(c / (4 * within_ms))
    facts = ["id", "event_time", "src_ip", "dst_ip", pick("bytes_in", "resp_bytes").alias("_in"), pick("bytes_out", "orig_bytes").alias("_out"), bucket(F.col("event_time")).alias("_bucket")]

    def near(asks: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
        """Activity of each question by minute. A key that is used again meets its questions in one or two stretches of time alone."""
        timed = asks.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("alert_time") - within_ms), bucket(F.col("alert_time") + within_ms))))
        pairs = timed.join(found, [*keys, "_bucket"]).filter(F.abs(F.col("event_time") - F.col("alert_time")) <= within_ms)
        minute = F.floor(F.col("event_time") / 60_000).cast("long")
        pairs = pairs.select("_ask", minute.alias("minute"), "id", "event_time", F.nullif("src_ip", F.lit("")).alias("src"), F.nullif("dst_ip", F.lit("")).alias("dst"), "_in", "_out")
        # dealt once by question and minute: all that follows stays in its task
        pairs = pairs.repartition("_ask", "minute").distinct()
        first = lambda peer: F.row_number().over(Window.partitionBy("_ask", "minute", peer).orderBy("id")) == 1
        pairs = pairs.withColumn("_new_src", first("src")).withColumn("_new_dst", first("dst"))
        return pairs.groupBy("_ask", "minute").agg(
            F.count(F.lit(1)).alias("events"), F.sum("_in").alias("bytes_in"), F.sum("_out").alias("bytes_out"),
            F.count_if(F.col("_new_src") & F.col("src").isNotNull()).alias("sources"),
            F.count_if(F.col("_new_dst") & F.col("dst").isNotNull()).alias("destinations"),
        )

    def told(asking: DataFrame, activity: DataFrame) -> DataFrame:
        owners = asking.select("alert_id", "_ask").repartition("_ask").distinct()
        return owners.join(activity, "_ask").select("alert_id", "minute", "events", "bytes_in", "bytes_out", "sources", "destinations")

    asks = asking.select("_ask", "alert_time", F.explode("_ids").alias("ftx_id")).distinct()
    linked = signals.select(*facts, F.explode(F.array_distinct(F.transform(F.split("ftx_ids", ","), lambda x: F.trim(x)))).alias("ftx_id")).filter("ftx_id <> ''")
    by_id = told(asking, near(asks, linked, ["ftx_id"]))
    known = asks.join(linked.select("ftx_id").distinct(), "ftx_id", "left_semi").select("_ask").distinct()
    rest = asking.filter("signal_id <> '' AND asset_id <> ''").join(known, "_ask", "left_anti")
    rest = rest.withColumn("_ask", F.coalesce(own, F.concat(at, F.length("signal_id").cast("string"), F.lit(" "), F.col("signal_id"), F.col("asset_id"))))
    asks = rest.select("_ask", "alert_time", "signal_id", "asset_id").distinct()
    found = signals.select(*facts, "signal_id", "asset_id")
    if newest is not None:
        latest = Window.partitionBy("signal_id", "asset_id").orderBy(F.col("event_time").desc(), F.col("id").desc())
        asked = asks.select("signal_id", "asset_id").distinct()
        found = signals.join(asked, ["signal_id", "asset_id"], "left_semi").select(*facts, "signal_id", "asset_id").withColumn("_rank", F.row_number().over(latest)).filter(F.col("_rank") <= newest).drop("_rank")
    return by_id.unionByName(told(rest, near(asks, found, ["signal_id", "asset_id"])))


def anomaly_detail(processed: DataFrame, raw: DataFrame) -> DataFrame:
    """Processed signals with what their raw signal says."""
    r = raw.select(F.col("id").alias("raw_signal_id"), F.col("detection_method"), F.col("evidence"), F.col("src_ip"), F.col("dst_ip"))
    return processed.join(r, "raw_signal_id", "left")


def overview_stats(alerts: DataFrame, signals: DataFrame) -> DataFrame:
    a = alerts.agg(F.count_if(F.col("alert_type") == "use_case").alias("incidents"), F.count_if(F.col("alert_type") == "signal").alias("alerts"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    s = signals.agg(F.count_if(F.col("visibility_mode") == "anomaly").alias("anomalies"), F.count(F.lit(1)).alias("raw"))
    return a.crossJoin(F.broadcast(s))  # one row each


def detection_timeline(alerts: DataFrame, now_ms: int) -> DataFrame:
    """24 hours up to now, zero filled: hours before now and alerts in each."""
    ago = F.floor((F.lit(now_ms) - F.col("event_time")) / 3_600_000).cast("int")
    counts = alerts.filter((F.col("event_time") > now_ms - 86_400_000) & (F.col("event_time") <= now_ms)).groupBy(ago.alias("hours_ago")).agg(F.count(F.lit(1)).alias("n"))
    hours = alerts.sparkSession.range(24).select(F.col("id").cast("int").alias("hours_ago"))
    return hours.join(F.broadcast(counts), "hours_ago", "left").select("hours_ago", F.coalesce("n", F.lit(0)).alias("n"))


def top_categories(alerts: DataFrame, n: int = 8) -> DataFrame:
    """Categories with their part of all alerts that have one, in percent."""
    counts = alerts.filter("category IS NOT NULL AND category <> ''").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return top(counts, n, "n", "category").crossJoin(F.broadcast(total)).select("category", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))  # one row


def top_tactics(alerts: DataFrame, n: int = 6) -> DataFrame:
    return top(alerts.filter("mitre_tactic IS NOT NULL AND mitre_tactic <> ''").groupBy("mitre_tactic").agg(F.count(F.lit(1)).alias("n")), n, "n", "mitre_tactic")


def top_assets(alerts: DataFrame, n: int = 5) -> DataFrame:
    return top(alerts.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"), F.max("name").alias("name"), F.max("risk_score").alias("risk")), n, "n", "asset_id")


def threshold_rule(df: DataFrame, entity: str, predicate: Column | str, least: int, window_ms: int = 300_000) -> DataFrame:
    """Entities and windows in which at least so many rows meet the predicate."""
    start = (F.floor(F.col("event_time") / window_ms) * window_ms).cast("long")
    return df.filter(predicate).groupBy(F.col(entity).alias("entity"), start.alias("window_start")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def rule_stats(alerts: DataFrame, now_ms: int) -> DataFrame:
    """Per rule: detections in 24 hours and 7 days, share of false positives, last time."""
    since = lambda ms: F.count_if(F.col("event_time") >= now_ms - ms)
    wrong = F.count_if(F.col("status") == "resolved")
    return alerts.groupBy("signal_id").agg(since(86_400_000).alias("detections_24h"), since(604_800_000).alias("detections_7d"), F.round(wrong / F.count(F.lit(1)), 4).alias("fp_rate"), F.max("event_time").alias("last_triggered"))


def signal_points(signals: DataFrame) -> DataFrame:
    """Points by method; signals below the bound are hidden."""
    c = F.col("detection_method")
    points = F.when(c == "rule", POINTS["rule"]).when(c == "zscore", POINTS["zscore"]).when(c == "hybrid", POINTS["hybrid"]).when(c == "ml", POINTS["ml"]).otherwise(0)
    return signals.withColumn("points", points).filter(F.col("points") >= HIDDEN_BELOW)


def risk_ledger(points: DataFrame, entity: str = "asset_id", block_ms: int = BLOCK_MS) -> DataFrame:
    """Running total of points per entity in time order: totals of its blocks of time first, then within each."""
    rows = in_blocks(points.select(F.col(entity).alias("entity"), "id", "event_time", "points"), block_ms)
    before = Window.partitionBy("entity").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("entity", "_block").agg(F.sum("points").alias("_sum"))
    blocks = blocks.withColumn("_ahead", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    order = Window.partitionBy("entity", "_block").orderBy("event_time", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = with_block_facts(rows, blocks, ["entity"])
    return held.select("entity", "id", "event_time", "points", (F.col("_ahead") + F.sum("points").over(order)).alias("running_total"))


def decayed(times: list[int], points: list[int]) -> list[int]:
    """risk after each entry: falls by DECAY_POINTS per full DECAY_MS since the last one, not below 0."""
    out, risk, last = [], 0, None
    for t, p in zip(times, points, strict=True):
        if last is not None:
            risk = max(0, risk - DECAY_POINTS * int((t - last) // DECAY_MS))
        risk += p
        out.append(risk)
        last = t
    return out


def risk_decay(points: DataFrame, entity: str = "asset_id", block_ms: int = BLOCK_MS) -> DataFrame:
    """Risk with decay after each entry, as a closed form over running sums.

    With whole steps of decay between neighbours, the risk before the floor is a running sum of points less
    decay; the floor at 0 lifts it by the lowest value that the sum has had just before any entry. A block of an entity's
    time is the map risk -> max(risk + sum, rise): its sum, and its lowest value, which compose; so each
    block is worked out by itself, then the blocks in order, one row for each.
    """
    rows = with_last_time(in_blocks(points.select(F.col(entity).alias("entity"), "id", "event_time", "points"), block_ms), ["entity"], "id")
    gap = F.floor((F.col("event_time") - F.col("_last")) / DECAY_MS)
    order = Window.partitionBy("entity", "_block").orderBy("event_time", "id")
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_fall", (F.coalesce(gap, F.lit(0)) * DECAY_POINTS).cast("long"))
    rows = rows.withColumn("_free", F.sum(F.col("points") - F.col("_fall")).over(until))
    blocks = rows.groupBy("entity", "_block").agg(F.sum(F.col("points") - F.col("_fall")).alias("_sum"), F.min(F.col("_free") - F.col("points")).alias("_low"))
    before = Window.partitionBy("entity").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_ahead", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    blocks = blocks.withColumn("_lowest", F.min(F.col("_ahead") + F.col("_low")).over(before)).drop("_sum", "_low")
    held = with_block_facts(rows, blocks, ["entity"])
    lowest = F.least(F.lit(0), F.col("_lowest"), F.col("_ahead") + F.min(F.col("_free") - F.col("points")).over(until))
    risk = F.col("_ahead") + F.col("_free") - lowest
    return held.select("entity", "id", "event_time", "points", risk.alias("risk")).withColumn("severity", S.risk_severity(F.col("risk")))


# Factors on a threshold by sensitivity.
SENSITIVITY = {"high": 1.0, "medium": 1.3, "low": 2.0}


def effective_threshold(floor: Column, chosen: Column, sensitivity: Column, critical: Column) -> Column:
    """The larger of the technical and the chosen threshold, times the sensitivity; 60 in critical mode."""
    factor = F.when(sensitivity == "high", 1.0).when(sensitivity == "medium", 1.3).otherwise(2.0)
    return F.when(critical, F.lit(60.0)).otherwise(F.greatest(floor, chosen) * factor)


def apply_suppressions(signals: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Drops signals that are disabled or suppressed until after their time; hidden ones go too.

    suppressions: signal_id, enabled boolean, until_ms long (null: not suppressed).
    """
    s = suppressions.select(F.col("signal_id").alias("_signal"), "enabled", "until_ms")
    off = (F.col("signal_id") == F.col("_signal")) & (~F.col("enabled") | (F.col("event_time") < F.col("until_ms")))
    return signals.filter(F.coalesce("visibility_mode", F.lit("alert")) != "hidden").join(s, off, "left_anti")


def kept_alerts(times: list[int], within_ms: int, cooldown_ms: int) -> list[bool]:
    """Greedy in time order: an alert is kept unless it follows the previous one within_ms or a kept one within cooldown_ms."""
    out, last, kept = [], None, None
    for t in times:
        keep = (last is None or t - last >= within_ms) and (kept is None or t - kept >= cooldown_ms)
        out.append(keep)
        last = t
        if keep:
            kept = t
    return out


def dedup_alerts(alerts: DataFrame, within_ms: int = 300_000, cooldown_ms: int = 900_000, per_hour: int = 10) -> DataFrame:
    """Repeats of (signal, asset), then the cooldown after a kept alert, then so many per asset and hour.

    An alert within_ms after the one before is never kept; that is told by columns, in blocks of time. So the greedy
    part, which streams over what is left in the order of (signal, asset, time), sees at most one alert of a pair for each within_ms,
    however many there were.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept = None, 0
        for rows in batches:
            keep = []
            for signal, asset, t in zip(rows["signal_id"], rows["asset_id"], rows["event_time"], strict=True):
                ok = key != (signal, asset) or t - kept >= cooldown_ms
                keep.append(ok)
                if ok:
                    key, kept = (signal, asset), t
            yield rows[pd.Series(keep, index=rows.index, dtype=bool)]

    apart = with_last_time(in_blocks(alerts), ["signal_id", "asset_id"], "id").filter(F.col("_last").isNull() | (F.col("event_time") - F.col("_last") >= within_ms)).select(*alerts.columns)
    ordered = apart.repartition("signal_id", "asset_id").sortWithinPartitions("signal_id", "asset_id", "event_time", "id")
    kept = ordered.mapInPandas(walk, alerts.schema)
    rank = F.row_number().over(Window.partitionBy("asset_id", F.floor(F.col("event_time") / 3_600_000)).orderBy("event_time", "id"))
    return kept.withColumn("_rank", rank).filter(F.col("_rank") <= per_hour).drop("_rank")


def escalate_severity(alerts: DataFrame, first_seen: DataFrame, intel: DataFrame) -> DataFrame:
    """One level up for each: listed peer, off hours (before 6, from 22), asset younger than 7 days, third of its signal in an hour.

    first_seen: asset_id, first_seen; intel: ip. Adds level (0 low to 3 critical) and escalated.
    """
    base = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)
    recent = Window.partitionBy("asset_id", "signal_id").orderBy(F.floor(F.col("event_time") / 1000)).rangeBetween(-3600, 0)
    bad = intel.select(F.col("ip").alias("_ip"), F.lit(1).alias("_bad")).distinct()
    rows = alerts.withColumn("_often", (F.count(F.lit(1)).over(recent) >= 3).cast("int"))
    rows = rows.join(first_seen.select("asset_id", "first_seen"), "asset_id", "left").join(bad, F.col("dst_ip") == F.col("_ip"), "left")
    hour = S.hour_of(F.col("event_time"))
    steps = F.coalesce("_bad", F.lit(0)) + ((hour < 6) | (hour >= 22)).cast("int") + F.coalesce((F.col("event_time") - F.col("first_seen") < 604_800_000).cast("int"), F.lit(0)) + F.col("_often")
    rows = rows.withColumn("level", F.least(F.lit(3), base + steps))
    name = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high"), F.lit("critical")), F.col("level") + 1)
    return rows.withColumn("escalated", name).drop("_often", "_ip", "_bad", "first_seen")


def correlate_use_case(signals: DataFrame, stages: tuple[str, ...], within_ms: int = 3_600_000) -> DataFrame:
    """Per entity the starts from which all stages follow in order within the window, earliest match of each.

    Stage by stage: the first later signal of the next stage is the smallest one after, a running minimum from
    the far end, so no pairs of signals are formed. A chain ends within_ms after its start at the latest, so it lies in the
    block of that length that it starts in, or in that and the next: each signal stands in its own block and in the one before, and
    an entity is as many tasks as blocks. kill_chain: the stages in order with the time of each, as JSON.
    """
    rows = signals.filter(F.col("signal_id").isin(*stages)).select("asset_id", "signal_id", "id", "event_time")
    own = F.floor(F.col("event_time") / within_ms)
    rows = rows.withColumn("_own", own).withColumn("_block", F.explode(F.array(own, own - 1)))
    later = Window.partitionBy("asset_id", "_block").orderBy(F.col("event_time").desc(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    k = len(stages) - 1
    rows = rows.withColumn(f"chain{k}", F.when(F.col("signal_id") == stages[k], F.struct(F.col("event_time").alias("end"), F.array("id").alias("ids"), F.array("event_time").alias("times"))))
    for j in range(k - 1, -1, -1):  # the best chain from here on: this signal, then the earliest ending of the next stage
        rows = rows.withColumn("next", F.min(f"chain{j + 1}").over(later))
        chain = F.struct(F.col("next.end").alias("end"), F.concat(F.array("id"), F.col("next.ids")).alias("ids"), F.concat(F.array("event_time"), F.col("next.times")).alias("times"))
        rows = rows.withColumn(f"chain{j}", F.when((F.col("signal_id") == stages[j]) & F.col("next").isNotNull(), chain)).drop("next")
    done = rows.filter((F.col("_own") == F.col("_block")) & F.col("chain0").isNotNull() & (F.col("chain0.end") - F.col("event_time") <= within_ms))
    ids = F.array_join(F.transform("chain0.ids", lambda x: x.cast("string")), ",")
    named = F.zip_with(F.array(*map(F.lit, stages)), "chain0.times", lambda s, t: F.concat(F.lit('{"signal_id":"'), s, F.lit('","time":'), t.cast("string"), F.lit("}")))
    return done.select("asset_id", F.col("event_time").alias("start_time"), F.col("chain0.end").alias("end_time"), ids.alias("signal_ids"), F.concat(F.lit("["), F.array_join(named, ","), F.lit("]")).alias("kill_chain"))


def zscore_baseline(df: DataFrame, entity: str, peer: str, value: str, least: int = 5, seed_mean: float | None = None, seed_std: float | None = None, real: float = 0.7) -> DataFrame:
    """Per row of a group with at least so many entities: z-score against its peers (blended with a seed)."""
    groups = df.groupBy(peer).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count_distinct(entity).alias("entities")).filter(F.col("entities") >= least)
    if seed_mean is not None:
        groups = groups.withColumn("mean", real * F.col("mean") + (1 - real) * seed_mean).withColumn("std", real * F.col("std") + (1 - real) * seed_std)
    z = F.when(F.col("std") > 0, (F.col(value) - F.col("mean")) / F.col("std")).otherwise(0.0)
    return df.join(groups, peer).withColumn("zscore", z)


# Signal type by method, and the minima of days, events and assets of each type.
SIGNAL_TYPES = {"rule": "rule_based", "zscore": "volumetric", "hybrid": "hybrid", "ml": "behavioral"}
PROMOTION = {"volumetric": (3, 50, 5), "behavioral": (7, 100, 10), "hybrid": (5, 75, 8), "rule_based": (1, 10, 1)}


def shadow_promotion(signals: DataFrame) -> DataFrame:
    """Per signal and method whether its days, events and assets reach the minima of its type."""
    facts = signals.groupBy("signal_id", "detection_method").agg(F.count_distinct(S.day_of(F.col("event_time"))).alias("days"), F.count(F.lit(1)).alias("events"), F.count_distinct("asset_id").alias("assets"))
    ok = F.lit(False)
    for method, kind in SIGNAL_TYPES.items():
        days, events, assets = PROMOTION[kind]
        ok = F.when(F.col("detection_method") == method, (F.col("days") >= days) & (F.col("events") >= events) & (F.col("assets") >= assets)).otherwise(ok)
    return facts.withColumn("promoted", ok)


def auto_demotion(facts: DataFrame) -> DataFrame:
    """facts: signal_id, fp_rate_7d, drift_3d, events_per_day_14d. The first rule that fits decides."""
    action = F.when(F.col("fp_rate_7d") >= 0.25, "shadow").when(F.col("drift_3d") >= 0.5, "retrain").when(F.col("events_per_day_14d") < 5, "review").otherwise("keep")
    return facts.withColumn("action", action)


def peer_group(assets: DataFrame) -> DataFrame:
    """Peer group by type; without one by vendor hints, then by system hints, else workstation."""
    os, vendor = F.lower(F.coalesce("os_hint", F.lit(""))), F.lower(F.coalesce("vendor", F.lit("")))
    named = F.when(F.col("asset_type").isin("workstation", "server", "docker", "iot", "network_device"), F.col("asset_type"))
    by_vendor = F.when(vendor.rlike("vmware|docker|kubernetes"), "docker").when(vendor.rlike("dell|hp|lenovo|apple"), "workstation")
    by_system = F.when(os.rlike("windows|mac|linux"), "workstation")
    return assets.withColumn("peer_group", F.coalesce(named, by_vendor, by_system, F.lit("workstation")))
