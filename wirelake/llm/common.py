"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import bisect
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents in one Arrow batch, and bytes: keeps a batch of long texts well inside a Python worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 32_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches where they are larger than BATCH_ROWS rows or BATCH_BYTES bytes.

    The bounds stay set, as tasks read them when they run.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only in a local session (tests, one machine) a temporary one is made and set where there is none.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="wirelake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what stands before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wirelake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of at most about 100 bytes each that may be broadcast.
MOST_BROADCAST = 300_000


def few(df: DataFrame, name: str) -> DataFrame:
    """A narrow table written down, to be broadcast if it is counted to be small; else joined by shuffle."""
    return light(written(df, name))


def light(df: DataFrame) -> DataFrame:
    """A narrow table that is written already, to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as set it apart from all columns of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def text_of(column: str | Column = "text") -> Column:
    """A null text counts as the empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def batch_of(schema: pa.Schema, columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


class Taken:
    """Spans that are taken already: tells by halving whether another one overlaps any of them."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []  # the farthest end of all spans up to this one
        for a, b in sorted(spans):
            self.starts.append(a)
            self.ends.append(max(b, self.ends[-1]) if self.ends else b)

    def overlaps(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end)  # spans that begin before the end
        return k > 0 and self.ends[k - 1] > start
