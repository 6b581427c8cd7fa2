"""The enrichment as one job: each batch of raw messages goes to all its outputs, parsed for each of them and kept nowhere.

Outputs are the typed tables of the log types, the flat enriched stream with its asset and threat columns, and the
dead letters. Every output of a batch lies in a folder of the batch's number and is written as a whole, so a batch that
fails between two of them and runs again leaves each row once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.operators import identity, matching, normalize
from wirelake.operators.common import HOUR_PARTS, shuffles_freed

Sink = Callable[[DataFrame, int], None]
#: Messages and digests are most of what is written; the default's files are over half as large again.
PACKED = "zstd"


@dataclass(frozen=True)
class Context:
    """What the asset and threat columns are taken from: bindings; ids (mac, ip, asset_id); types (asset_id, asset_type); threats (ip)."""

    bindings: DataFrame
    ids: DataFrame
    types: DataFrame
    threats: DataFrame | None = None


def enriched(good: DataFrame, context: Context, ingest_ms: Column | None = None) -> DataFrame:
    """Flat records of normalize.to_stream_record with asset_id, asset_type and the blacklist flags filled in.

    good: from parse_envelope and split_dead_letters. Where the lookup moves events, it moves the messages as they came; records
    are made of them afterwards.
    """
    rows = identity.asset_columns(normalize.lookup_keys(good), context.bindings, context.ids, context.types)
    records = normalize.to_stream_record(rows, ingest_ms)
    return matching.flag_threat_ips(records, context.threats).select(*records.columns)


def to_folder(path: str) -> Sink:
    """A sink that writes each batch as Parquet into its own folder below path."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").option("compression", PACKED).parquet(f"{path}/batch={number}")

    return write


def table_rows(good: DataFrame, kind: str, ingest_ms: Column | None = None) -> DataFrame:
    """The typed rows of a log type with the columns of their hour folders, an hour's rows in one task.

    Messages move as they came, by a clue of their hour, and are read where they are written: typed rows take over three times
    the shuffle. The folder follows from the message as read, so a clue that errs costs a file and no more.
    """
    hour = normalize.message_hour(F.col("raw"))
    hour = hour if ingest_ms is None else F.coalesce(F.floor(ingest_ms / 3_600_000), hour)
    dealt = good.filter(F.col("log_type") == kind).select("log_type", "nested", "raw").repartition(hour)
    rows = normalize.project_table(dealt, kind, ingest_ms)
    ts = F.timestamp_millis("ingest_time")
    parts = zip(HOUR_PARTS, ("yyyy", "MM", "dd", "HH"), strict=True)
    return rows.withColumns({name: F.date_format(ts, form) for name, form in parts})


def write_tables(good: DataFrame, number: int, base: str, ingest_ms: Column | None = None) -> None:
    """The typed tables of the types that a batch holds, as log_type/batch/year/month/day/hour of the ingest time.

    files.open_lake reads them. good: from parse_envelope and split_dead_letters.
    """
    kinds = good.select("log_type").distinct().collect()  # at most as many as there are log types
    for kind in sorted(r["log_type"] for r in kinds):
        rows = table_rows(good, kind, ingest_ms)
        rows.write.mode("overwrite").option("compression", PACKED).partitionBy(*HOUR_PARTS).parquet(f"{base}/log_type={kind}/batch={number}")


def enrich_job(lake: str, records: Sink, letters: Sink, context: Callable[[], Context] | None = None, value: str = "value", ingest_ms: Column | None = None) -> Sink:
    """For foreachBatch over raw messages. lake: the tables' folder; records and letters: sinks of the flat stream and the
    dead letters, such as to_folder, or a batch writer to a topic (then at least once); context: asked for each batch.
    """

    def each(batch: DataFrame, number: int) -> None:
        # each output parses what it needs: a batch's parsed messages, kept, would take several times its size on disk
        parsed = normalize.parse_envelope(batch, value)
        good, bad = normalize.split_dead_letters(parsed, value)
        # what one output shuffled is gone before the next one begins
        with shuffles_freed(batch.sparkSession):
            write_tables(good, number, lake, ingest_ms)
            records(normalize.to_stream_record(good, ingest_ms) if context is None else enriched(good, context(), ingest_ms), number)
            letters(bad, number)

    return each

