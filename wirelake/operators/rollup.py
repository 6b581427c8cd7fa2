"""Hourly partial results, kept in the lake's own folder and added up to windows: dashboards and baselines.

A refresh reads the hours that are new and writes their partials, an hour a folder; a refresh that runs again replaces the
hours it wrote. Windows are whole hours up to the last full one, and add up what the hours hold, so they are
exact: counts as sums of all values' counts, means and deviations as merged moments.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelake.operators import logs
from wirelake.operators.common import in_hours, time_column, window_ms

HOUR_MS = 3_600_000


@dataclass(frozen=True)
class HourLog:
    """Partials of one schema in a folder, by the hour that they belong to (hour_ms, its first millisecond)."""

    path: str
    schema: str

    def write(self, rows: DataFrame) -> None:
        """Replaces the hours that rows (with hour_ms) has, and leaves the others."""
        rows.repartition("hour_ms").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour_ms").parquet(self.path)

    def read(self, spark: SparkSession, low_ms: int | None, high_ms: int) -> DataFrame:
        """The hours from low_ms on and before high_ms; only their folders are read."""
        kinds = T._parse_datatype_string(self.schema).add("hour_ms", T.LongType())
        try:
            rows = spark.read.schema(kinds).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = spark.createDataFrame([], kinds)
        rows = rows.filter(F.col("hour_ms") < high_ms)
        return rows if low_ms is None else rows.filter(F.col("hour_ms") >= low_ms)


def new_rows(df: DataFrame, since_ms: int | None, until_ms: int) -> DataFrame:
    """Rows whose time lies from since_ms on and before until_ms; of the lake only the folders of these hours are read."""
    time = logs.millis(time_column(df))
    rows = in_hours(df, since_ms, until_ms) if time_column(df) == "ingest_time" else df
    rows = rows.filter(time < until_ms)
    return rows if since_ms is None else rows.filter(time >= since_ms)


def hour_of(df: DataFrame) -> Column:
    return (F.floor(logs.millis(time_column(df)) / HOUR_MS) * HOUR_MS).cast("long")


# --- dashboards --------------------------------------------------------------------------------------


def dashboard_log(path: str) -> HourLog:
    return HourLog(path, "log_type string, widget string, value string, n long")


def refresh_dashboards(lake: dict[str, DataFrame], log: HourLog, since_ms: int | None, until_ms: int) -> None:
    """Writes the counts of every source, widget and value for the full hours from since_ms on and before until_ms."""
    until = until_ms - until_ms % HOUR_MS
    since = None if since_ms is None else since_ms - since_ms % HOUR_MS
    parts = [logs.counted_widgets(name, new_rows(df, since, until), hour_of(df), "hour_ms") for name, df in lake.items()]
    log.write(reduce(DataFrame.unionByName, parts))


def dashboards(spark: SparkSession, log: HourLog, windows: tuple[str, ...], now_ms: int, n: int = 10) -> DataFrame:
    """What logs.lake_bundle gives for windows that end with the last full hour, from the kept counts alone."""
    until = now_ms - now_ms % HOUR_MS
    lengths = {w: window_ms(w) for w in windows}
    longest = None if None in lengths.values() else until - max(lengths.values())
    inside = [F.when(F.lit(True) if ms is None else F.col("hour_ms") >= until - ms, F.lit(w)) for w, ms in lengths.items()]
    rows = log.read(spark, longest, until).withColumn("window", F.explode(F.array_compact(F.array(*inside))))
    return logs.ranked_widgets(rows.groupBy("log_type", "window", "widget", "value").agg(F.sum("n").alias("n")), n)


# --- baselines ---------------------------------------------------------------------------------------

#: Parts of the real and the seed values in a blended baseline.
REAL, SEED = 0.7, 0.3
#: Assets that a peer group must have for a baseline.
LEAST_ASSETS = 5


def baseline_log(path: str) -> HourLog:
    return HourLog(path, "asset string, peers string, n long, mean double, m2 double")


def moments(df: DataFrame, asset: str, peers: str, value: str) -> DataFrame:
    """asset, peers, hour_ms, and of the value's numbers in that hour: n, mean, m2 (the sum of squared deviations)."""
    held = df.filter(F.col(value).isNotNull()).select(F.col(asset).alias("asset"), F.col(peers).alias("peers"), hour_of(df).alias("hour_ms"), F.col(value).cast("double").alias("x"))
    return held.groupBy("asset", "peers", "hour_ms").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count(F.lit(1))).alias("m2"))


def refresh_baselines(df: DataFrame, log: HourLog, asset: str, peers: str, value: str, since_ms: int | None, until_ms: int) -> None:
    until = until_ms - until_ms % HOUR_MS
    log.write(moments(new_rows(df, None if since_ms is None else since_ms - since_ms % HOUR_MS, until), asset, peers, value))


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    """One row of n, mean and std for each of the keys, from moments of parts of its numbers.

    Deviations are taken from the merged mean, part by part, so nothing large cancels. The means come from a sum of each key's
    parts, joined back.
    """
    whole = parts.groupBy(*keys).agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    named = whole.select(*(F.col(k).alias(f"_{k}") for k in keys), "_n", "_mean")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    spread = F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), 2))
    out = parts.join(named, same).groupBy(*keys).agg(F.first("_n").alias("n"), F.first("_mean").alias("mean"), spread.alias("_m2"))
    return out.select(*keys, "n", "mean", F.sqrt(F.col("_m2") / F.col("n")).alias("std"))


def baselines(spark: SparkSession, log: HourLog, now_ms: int, hours: int = 24, seed: tuple[float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(asset, peers, n, mean, std), (peers, n, mean, std, assets) over the full hours up to now.

    The second table has the groups of at least LEAST_ASSETS assets. seed: a mean and a deviation that the groups' own are blended with.
    """
    until = now_ms - now_ms % HOUR_MS
    rows = log.read(spark, until - hours * HOUR_MS, until)
    own = merged(rows, "asset", "peers")
    sizes = own.groupBy("peers").agg(F.count(F.lit(1)).alias("assets")).filter(F.col("assets") >= LEAST_ASSETS)
    groups = merged(own.select("asset", "peers", "n", "mean", (F.col("n") * F.pow("std", 2)).alias("m2")), "peers").join(sizes, "peers")
    if seed is not None:
        groups = groups.withColumn("mean", REAL * F.col("mean") + SEED * seed[0]).withColumn("std", REAL * F.col("std") + SEED * seed[1])
    return own, groups


def scored(df: DataFrame, own: DataFrame, groups: DataFrame, asset: str, peers: str, value: str) -> DataFrame:
    """df with zscore_asset and zscore_peers: how far the value lies from the asset's own baseline, and from its group's.

    Null where there is no baseline, 0 where it has no deviation.
    """
    a = own.select(F.col("asset").alias("_a"), F.col("peers").alias("_p"), F.col("mean").alias("_am"), F.col("std").alias("_as"))
    g = groups.select(F.col("peers").alias("_g"), F.col("mean").alias("_gm"), F.col("std").alias("_gs"))
    z = lambda m, s: F.when(F.col(s) > 0, (F.col(value) - F.col(m)) / F.col(s)).when(F.col(s).isNotNull(), 0.0)
    rows = df.join(a, (F.col(asset) == F.col("_a")) & F.col(peers).eqNullSafe(F.col("_p")), "left").join(g, F.col(peers) == F.col("_g"), "left")
    return rows.select(*df.columns, z("_am", "_as").alias("zscore_asset"), z("_gm", "_gs").alias("zscore_peers"))
