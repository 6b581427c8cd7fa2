"""Readers and writers: JSON lines, packet text, CSV sets, the partitioned lake, Kafka, service logs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelake import schemas
from wirelake.functions import scalars as S
from wirelake.operators import normalize
from wirelake.operators.common import HOUR_PARTS


def read_kafka_raw(spark: SparkSession, brokers: str, topic: str, streaming: bool = True, most: int | None = None) -> DataFrame:
    """A topic's messages as value text, from the earliest offset. Needs Spark's Kafka connector.

    most: messages that a stream takes at once, so that the first batch over a full topic stays bounded.
    """
    reader = spark.readStream if streaming else spark.read
    if streaming and most:
        reader = reader.option("maxOffsetsPerTrigger", most)
    rows = reader.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return rows.select(F.col("value").cast("string").alias("value"))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a source of fewer files than there are cores, dealt out over all cores before costly work; else as they are.

    A scan of so many splits that they keep all cores busy stays where it is. Otherwise each split is dealt to several
    tasks, so that a task's share is bounded by a split's size and doesn't grow with the source.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    splits = df.rdd.getNumPartitions()
    return df if splits >= 2 * cores else df.repartition(max(cores, 4 * splits))


def read_zeek_json(spark: SparkSession, path: str, log_type: str) -> DataFrame:
    """JSON lines of one log type with declared types; bad lines are left out; ids renamed, ingest_time is ts."""
    rows = spark.read.schema(schemas.raw_schema(log_type)).option("mode", "DROPMALFORMED").json(path)
    promoted = schemas.promotions(log_type)
    ms = (F.col("ts") * 1000).cast("bigint")
    columns = [F.col(f"`{f}`").alias(promoted.get(f, schemas.table_column(log_type, f))) for f in rows.columns if f != "ts"]
    return rows.select(ms.alias("event_time"), ms.alias("ingest_time"), *columns)


def packet_rows(lines: DataFrame, source: Column) -> DataFrame:
    """Text lines of a packet dump (time protocol source > destination: message) as connections.

    A trailing .port is split off. lines: column value.
    """
    pattern = r"^(\d+(?:\.\d+)?) (IP6?|ARP),? (\S+) > (\S+?): ?(.*)$"
    part = lambda i: F.regexp_extract("value", pattern, i)
    rows = lines.filter(F.col("value").rlike(pattern)).select(part(1).alias("ts"), part(2).alias("kind"), part(3).alias("src"), part(4).alias("dst"), part(5).alias("msg"))
    end = r"^(.*)\.(\d+)$"
    four = r"^\d+\.\d+\.\d+\.\d+$"
    ip = lambda c: F.when(F.col(c).rlike(end) & ~F.col(c).rlike(four), F.regexp_extract(c, end, 1)).otherwise(F.col(c))
    port = lambda c: F.when(F.col(c).rlike(end) & ~F.col(c).rlike(four), F.regexp_extract(c, end, 2).try_cast("int")).otherwise(0)
    boot = F.concat_ws(" ", "src", "dst").rlike(r"\.6[78]")
    rows = rows.select(S.event_ms(F.col("ts")).alias("event_time"), ip("src").alias("src_ip"), ip("dst").alias("dst_ip"), port("src").alias("src_port"), port("dst").alias("dst_port"), F.when(boot, "udp").otherwise(F.lower("kind")).alias("protocol"), "msg")
    dhcp = F.lower("msg").contains("dhcp") | F.col("src_port").isin(67, 68) | F.col("dst_port").isin(67, 68)
    return rows.select(F.concat(source, F.lit("-"), F.monotonically_increasing_id().cast("string")).alias("flow_id"), "event_time", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", F.when(dhcp, "dhcp").otherwise("").alias("service"))


def read_packet_text(spark: SparkSession, path: str) -> DataFrame:
    return packet_rows(spark.read.text(path), F.input_file_name())


def lake_schema(spark: SparkSession, log_type: str) -> T.StructType:
    """The declared columns of a log type's table in the lake, and its folders' columns."""
    parts = [T.StructField(c, T.IntegerType()) for c in HOUR_PARTS]
    return T.StructType([*normalize.table_schema(spark, log_type).fields, *parts])


def open_lake(spark: SparkSession, base: str, types: tuple[str, ...] = schemas.LOG_TYPES, views: bool = True, declared: bool = True) -> dict[str, DataFrame]:
    """One table per log type that has files under base, in log_type=<type> or <type>; with views also as temporary views.

    Tables have the declared columns of their types, whatever single files hold: missing ones are null, and no file is opened to
    find out. Not declared: the columns that the files have.
    """
    found = {}
    for name in types:
        for folder in (f"log_type={name}", name):
            try:
                reader = spark.read.option("basePath", base)
                if declared:
                    reader = reader.schema(lake_schema(spark, name))
                rows = reader.parquet(f"{base.rstrip('/')}/{folder}")
            except AnalysisException as e:
                # no such folder, or none with files
                if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                    raise
                continue
            if declared and not rows.inputFiles():
                continue
            found[name] = rows.drop("log_type", "batch")
            if views:
                found[name].createOrReplaceTempView(name)
            break
    return found


def write_lake(df: DataFrame, base: str, by: str = "ingest_time", files_per_hour: int = 1, mode: str = "append") -> None:
    """Parquet by log_type, year, month, day, hour of the given time; so many files an hour and type.

    mode overwrite replaces the hours that df has rows of, and leaves the others.
    """
    ts = F.timestamp_millis(by)
    rows = df.withColumns({"year": F.date_format(ts, "yyyy"), "month": F.date_format(ts, "MM"), "day": F.date_format(ts, "dd"), "hour": F.date_format(ts, "HH")})
    keys = ["log_type", "year", "month", "day", "hour"]
    salt = [F.pmod(F.xxhash64("ftx_id"), F.lit(files_per_hour))] if files_per_hour > 1 else []
    rows.repartition(*keys, *salt).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(base)


def compact_hours(spark: SparkSession, base: str, to: str, before_ms: int, since_ms: int = 0, files_per_hour: int = 1) -> None:
    """The hours of a lake that a stream wrote in many small files, as few large ones in the lake at to.

    Takes the hours of ingest_time that begin at since_ms or later and end by before_ms; the scan reads those
    alone. A run that is repeated replaces the hours it wrote before. The stream's own files stay as they are.
    """
    hour = F.make_timestamp(*(F.col(c).cast("int") for c in ("year", "month", "day", "hour")), F.lit(0), F.lit(0))
    for name, rows in open_lake(spark, base, views=False, declared=False).items():
        past = rows.filter((F.unix_millis(hour) >= since_ms) & (F.unix_millis(hour) + 3_600_000 <= before_ms))
        write_lake(past.withColumn("log_type", F.lit(name)), to, files_per_hour=files_per_hour, mode="overwrite")


def table_counts(lake: dict[str, DataFrame]) -> DataFrame:
    """Rows and status of each table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("log_type"), "n") for name, df in lake.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("status", F.when(F.col("n") > 0, "active").otherwise("no_data"))


def schema_catalog(spark: SparkSession, lake: dict[str, DataFrame]) -> DataFrame:
    """Table, field and plain type name of every column."""
    # Names of types.
    names = {"boolean": "bool", "bigint": "bigint", "int": "int", "double": "double", "string": "varchar"}
    rows = [(name, field, names.get(kind, kind)) for name, df in lake.items() for field, kind in df.dtypes]
    return spark.createDataFrame(rows, "log_type string, field string, type string")


def kafka_records(df: DataFrame, key: str = "flow_id") -> DataFrame:
    """Records to write: JSON value and a key. A key of few values, as log_type, loads few partitions."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_kafka_enriched(df: DataFrame, brokers: str, topic: str, key: str = "flow_id", checkpoint: str | None = None):
    """Batch or stream to a topic, lz4. Needs Spark's Kafka connector."""
    rows = kafka_records(df, key)
    options = {"kafka.bootstrap.servers": brokers, "topic": topic, "kafka.compression.type": "lz4"}
    if df.isStreaming:
        return rows.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint).start()
    return rows.write.format("kafka").options(**options).save()


def fan_out(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, available_now: bool = False):
    """Every batch once to each sink, read once."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for sink in sinks:
            sink(batch, number)
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def load_reference_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A set of comma separated lines; blank ones and those that begin with # are skipped, the last column keeps its commas."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> '' AND NOT startswith(line, '#')")
    parts = F.split("line", ",", len(columns))
    return lines.select(*(F.trim(F.get(parts, F.lit(i))).alias(c) for i, c in enumerate(columns)))


# Words that make a service log line worth keeping.
KEYWORDS = ("critical", "error", "warning", "warn", "drop", "failed", "exception")


def triage_lines(lines: DataFrame, n: int = 80) -> DataFrame:
    """The last n telling lines of each file with their level. lines: file, line_no, value."""
    low = F.lower("value")
    kept = lines.filter(low.rlike("|".join(KEYWORDS)))
    level = F.when(low.contains("critical"), "critical").when(low.contains("error"), "error").when(low.contains("warn"), "warning").when(low.contains("drop"), "drop").otherwise("info")
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("line_no")))
    text = F.when(F.length("value") > 400, F.right("value", F.lit(400))).otherwise(F.col("value"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= n).select("file", "line_no", level.alias("level"), text.alias("line"))


def triage_text_logs(spark: SparkSession, paths: list[str], n: int = 80) -> DataFrame:
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")
    return triage_lines(rows, n)


def dropped_packets(message: Column) -> Column:
    """The number after "dropped ="; else 1 if the message says drop; else 0."""
    number = F.regexp_extract(message, r"(?i)dropped\s*=\s*(\d+)", 1).try_cast("long")
    return F.coalesce(number, F.lower(message).contains("drop").cast("long"), F.lit(0))


def extract_dropped_packets(df: DataFrame, source: str = "source", message: str = "message") -> DataFrame:
    return df.groupBy(source).agg(F.sum(dropped_packets(F.col(message))).alias("dropped"))


def merge_sources(lakes: dict[str, DataFrame]) -> DataFrame:
    """The same table of several sources with source_id."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source_id", F.lit(name)) for name, df in lakes.items()])


def source_summary(conn: DataFrame, n: int = 8) -> DataFrame:
    """Per source its rows and its n most common protocols, largest first. conn: with source_id."""
    counts = conn.groupBy("source_id", F.coalesce("protocol", F.lit("unknown")).alias("protocol")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("n"), "protocol"))
    rows = counts.withColumn("rank", rank).withColumn("total", F.sum("n").over(Window.partitionBy("source_id"))).filter(F.col("rank") <= n)
    return rows.groupBy("source_id").agg(F.first("total").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "protocol"))), lambda x: x["protocol"]), ",").alias("protocols"))
