"""Helpers of the log operators."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirelake.functions import scalars as S

#: Labels of time windows, in milliseconds; "all" has none.
WINDOWS = {"1h": 3_600_000, "6h": 21_600_000, "24h": 86_400_000, "7d": 604_800_000, "30d": 2_592_000_000}
_ALIASES = {"last hour": "1h", "last 1 hour": "1h", "last 6 hours": "6h", "last 24 hours": "24h", "last 7 days": "7d", "last 30 days": "30d", "all time": "all"}


def window_ms(label: str) -> int | None:
    """Length of a window by its label or its "Last ..." alias; None for all time."""
    label = _ALIASES.get(label.strip().lower(), label.strip().lower())
    if label == "all":
        return None
    return WINDOWS[label]


#: The folders of the lake, of the ingest time.
HOUR_PARTS = ("year", "month", "day", "hour")


def in_hours(df: DataFrame, low_ms: int | None = None, high_ms: int | None = None) -> DataFrame:
    """Rows of a table of the lake whose folder's hour may hold times from low_ms on and before high_ms; other tables as they are.

    The condition is on the folders' columns alone, so that a scan lists and reads those hours only. Times in seconds lie in
    folders of 1970, which stay.
    """
    if not set(HOUR_PARTS) <= set(df.columns):
        return df
    year, month, day, hour = (F.col(c).cast("int") for c in HOUR_PARTS)
    number = ((year * 100 + month) * 100 + day) * 100 + hour
    at = lambda ms: int(time.strftime("%Y%m%d%H", time.gmtime(ms // 1000)))
    if low_ms is not None:
        df = df.filter((number >= at(low_ms)) | (year == 1970))
    if high_ms is not None:
        df = df.filter(number <= at(high_ms - 1))
    return df


def time_column(df: DataFrame) -> str:
    """The time that windows go by: of ingest, where a table has it."""
    return "ingest_time" if "ingest_time" in df.columns else "event_time"


def in_window(df: DataFrame, label: str, now_ms: int, column: str | None = None) -> DataFrame:
    """Rows from now minus the window on, by ingest time unless a column is named; a number up to 1e12 counts as seconds.

    On a table of the lake the window reads the folders of its hours alone. The bound compares the column itself where it
    holds milliseconds, so a scan can prune by it.
    """
    length = window_ms(label)
    if length is None:
        return df
    low = now_ms - length
    column = column or time_column(df)
    if column == "ingest_time":
        df = in_hours(df, low)
    c = F.col(column)
    return df.filter((c >= low) | ((c <= 1_000_000_000_000) & (c >= low // 1000)))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a local session may go without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="wirelake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back, so that rounds pile up no lineage and a lost executor costs no earlier step."""
    path = f"{shared_folder(df.sparkSession)}/wirelake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it the files of a query's shuffles go when the query ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Blocks of time in which the rows of one entity are worked on, in milliseconds.
BLOCK_MS = 3_600_000


def in_blocks(df: DataFrame, block_ms: int = BLOCK_MS) -> DataFrame:
    """df with _block: the stretch of time that event_time lies in. An entity's rows are worked on block by block."""
    return df.withColumn("_block", F.floor(F.col("event_time") / block_ms))


def with_block_facts(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of facts, which has one row for each block of the keys (nulls among them)."""
    own = [*keys, "_block"]
    named = facts.select(*(F.col(k).alias(f"_f{i}") for i, k in enumerate(own)), *(c for c in facts.columns if c not in own))
    same = [F.col(k).eqNullSafe(F.col(f"_f{i}")) for i, k in enumerate(own)]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return rows.join(named, condition).drop(*(f"_f{i}" for i in range(len(own))))


def with_last_time(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """rows (with _block) with _last: the event_time of the row before, in the order of event_time and the columns given.

    The row before a block's first one is the last of the block before, known from one row for each block.
    """
    ends = rows.groupBy(*keys, "_block").agg(F.max("event_time").alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_block"))).drop("_end")
    within = Window.partitionBy(*keys, "_block").orderBy("event_time", *order)
    held = with_block_facts(rows, ends, keys)
    return held.withColumn("_last", F.coalesce(F.lag("event_time").over(within), F.col("_before"))).drop("_before")


def top(df: DataFrame, n: int, value: str, *keys: str) -> DataFrame:
    """The n rows of the largest value; ties go by the keys, nulls first."""
    return df.orderBy(F.col(value).desc(), *(F.col(k).asc_nulls_first() for k in keys)).limit(n)


def counted(df: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def total_bytes() -> Column:
    """Both directions; a missing count is 0."""
    return F.coalesce(F.col("orig_bytes"), F.lit(0)) + F.coalesce(F.col("resp_bytes"), F.lit(0))


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    return df.offset((number - 1) * size).limit(size)


def clean_result(df: DataFrame) -> DataFrame:
    """A result as it is handed out: numbers that are none or infinite become null (in arrays too), times ISO text."""

    def cleaned(name: str, kind: str) -> Column:
        c = F.col(f"`{name.replace('`', '``')}`")
        if kind in ("double", "float"):
            return S.finite_or_null(c)
        if kind in ("array<double>", "array<float>"):
            return F.transform(c, S.finite_or_null)
        if kind in ("timestamp", "timestamp_ntz"):
            whole = F.date_trunc("second", c) == c
            return F.when(whole, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        return c.cast("string") if kind == "date" else c

    return df.select(*(cleaned(n, k).alias(n) for n, k in df.dtypes))
