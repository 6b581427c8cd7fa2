"""Asset profiles kept as a log of parts: each batch writes its own part, and parts are merged in levels.

A batch's profiles are a part of level 0. Every ``fan`` parts of a level are merged into one part of the next, so a
profile is written once for each level, and the bytes that batches write follow the batches, not the table. Which parts
count after batch n are the digits of n + 1 to the base ``fan``, so nothing but the last batch's number needs to be
kept. A batch that runs again writes the same parts again. A slot is used anew only after another full
round of its level, so a reader of the last batch has time for ``fan`` more of them.

With ttl_ms a host that is not seen for longer starts anew, and merges leave out what is past that at their time, so the log holds
the hosts of that time alone. Gaps count between parts: events of one batch belong together.

Everything lies in one folder that the driver and the executors share.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirelake.operators import assets


@dataclass(frozen=True)
class ProfileLog:
    """path: the folder; fan: parts of a level that are merged; ttl_ms: how long an unseen host is kept."""

    path: str
    fan: int = 8
    ttl_ms: int | None = None

    def merge(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch over assets.sides: adds batch number (0, 1, ...) to the log."""
        spark = batch.sparkSession
        self.add(assets.counters(batch, sketched=True), number)
        done, level, size = number + 1, 0, self.fan
        while done % size == 0:
            parts = [self._read(spark, level, done // (size // self.fan) - self.fan + i, i) for i in range(self.fan)]
            merged = self._summed(reduce(DataFrame.unionByName, parts))
            if self.ttl_ms is not None:  # nothing newer lies in other parts, so what is past the time is past it for good
                latest = merged.agg(F.max("last_seen").alias("_latest"))
                merged = merged.crossJoin(F.broadcast(latest)).filter(F.col("last_seen") >= F.col("_latest") - self.ttl_ms).drop("_latest")  # one row
            self._write(merged, level + 1, done // size - 1)
            level, size = level + 1, size * self.fan
        spark.range(1).select(F.lit(number).cast("long").alias("number")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/last/{number % 2}")

    def add(self, profiles: DataFrame, number: int) -> None:
        self._write(profiles, 0, number)

    def parts(self, number: int) -> list[tuple[int, int]]:
        """(level, count of parts of that level before it) of the parts that count after the batch, oldest first."""
        found, done, level = [], number + 1, 0
        while done:
            found += [(level, k) for k in range(done - 1, done - done % self.fan - 1, -1)]
            done, level = done // self.fan, level + 1
        return found[::-1]

    def profiles(self, spark: SparkSession, number: int | None = None) -> DataFrame:
        """All profiles after a batch, the last one if none is named."""
        number = self.last(spark) if number is None else number
        if number is None:
            raise ValueError(f"no batch has been written to {self.path}")
        rows = self._summed(reduce(DataFrame.unionByName, [self._read(spark, level, k, i) for i, (level, k) in enumerate(self.parts(number))]))
        if self.ttl_ms is None:
            return rows
        latest = rows.agg(F.max("last_seen").alias("_latest"))
        return rows.crossJoin(F.broadcast(latest)).filter(F.col("last_seen") >= F.col("_latest") - self.ttl_ms).drop("_latest")  # one row

    def last(self, spark: SparkSession) -> int | None:
        """The number of the last batch that was written in full."""
        found = []
        for slot in (0, 1):
            try:
                found += [r["number"] for r in spark.read.schema("number long").parquet(f"{self.path}/last/{slot}").collect()]
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        return max(found, default=None)

    def _slot(self, level: int, k: int) -> str:
        return f"{self.path}/level{level}/{k % (2 * self.fan)}"

    def _write(self, rows: DataFrame, level: int, k: int) -> None:
        rows.write.mode("overwrite").parquet(self._slot(level, k))

    def _read(self, spark: SparkSession, level: int, k: int, order: int) -> DataFrame:
        kinds = "ip string, peers_out binary, peers_in binary, " + ", ".join(f"{c} long" for c in (*assets.COUNTERS, "first_seen", "last_seen"))
        return spark.read.schema(kinds).parquet(self._slot(level, k)).withColumn("_part", F.lit(order))

    def _summed(self, parts: DataFrame) -> DataFrame:
        """Parts of each address together; with ttl_ms only those after its last long silence."""
        if self.ttl_ms is not None:
            by_part = Window.partitionBy("ip").orderBy("_part")  # a row for each part that knows the address
            silent = F.col("first_seen") - F.max("last_seen").over(by_part.rowsBetween(Window.unboundedPreceding, -1)) > self.ttl_ms
            parts = parts.withColumn("_since", F.count_if(silent).over(by_part)).withColumn("_now", F.max("_since").over(Window.partitionBy("ip"))).filter("_since = _now")
        return assets.summed(parts)
