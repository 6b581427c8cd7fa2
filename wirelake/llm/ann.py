"""Nearest neighbours by an adaptive dimension scan within probed lists.

A bounded sample fixes the centres of the lists and how many a query has to probe to meet most of its true
neighbours; every vector goes to the list of its nearest centre. Within a list, vectors and query are turned by
one random rotation, and distances are summed block of columns by block: after each block a test compares the
partial distance, scaled to all columns, with the tenth best distance so far; a candidate that is farther beyond
chance is given up. What is left is measured exactly on the original vectors.

Lists are dealt out in chunks of bounded size, and so are the queries that probe them, so a list that holds a
third of all vectors is many tasks' work. Every vector is indexed; no candidate is capped.

Defined cases: vectors that are null, zero or that hold null or non-finite components take no part, nor do rows
with a null id or (as no distance is defined) a vector of another length than most. Every other row is a
candidate for every query row but itself, also where ids repeat: each query row has a ranking of its own, equal
rows the same one, and rows of its own id may stand in it. Equal rows (id and vector) are searched once and
counted; ties go to the smaller id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake.llm.common import batch_of, bounded_batches

#: Vectors at most that the centres are fitted on, taken in the order of a hash of the id.
SAMPLE = 20_000
MOST_LISTS = 1024
#: Share of the true neighbours that should lie in the probed lists, and sample rows that tell how many these are.
COVERED, JUDGES = 0.97, 200
#: Vectors in one chunk of a list, and queries in one group that probes it.
CHUNK, QUERY_CHUNK = 4096, 512
#: Columns in a block, and the strictness of the test (larger: fewer neighbours lost).
BLOCK, EPSILON = 16, 2.1


def sound(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


@dataclass
class Index:
    centres: np.ndarray
    rotation: np.ndarray
    sizes: np.ndarray  # vectors in each list

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return (_squares(x, self.centres)).argmin(axis=1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None]


def centres(sample: np.ndarray, lists: int, seed: int = 5, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from seeded starts; an empty list starts anew at the point farthest from its centre."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        squares = _squares(sample, c)
        own = squares.argmin(axis=1)
        count = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        far = np.argsort(-squares[np.arange(len(sample)), own], kind="stable")
        empty = np.flatnonzero(count == 0)
        c = sums / np.maximum(count, 1)[:, None]
        c[empty] = sample[far[: len(empty)]]
    return c


def probes_for(sample: np.ndarray, c: np.ndarray, k: int, covered: float = COVERED) -> int:
    """So many nearest lists hold that share of the k nearest sample rows of some sample rows."""
    lists = _squares(sample, c).argmin(axis=1)
    ranks: list[np.ndarray] = []
    for i in range(0, len(sample), max(1, len(sample) // JUDGES)):
        squares = ((sample - sample[i]) ** 2).sum(axis=1)
        squares[i] = np.inf
        nearest = np.argsort(squares, kind="stable")[: min(k, len(sample) - 1)]
        place = np.empty(len(c), np.int64)
        place[np.argsort(_squares(sample[i : i + 1], c)[0], kind="stable")] = np.arange(1, len(c) + 1)
        ranks.append(place[lists[nearest]])
    ranks = np.concatenate(ranks)
    return int(np.ceil(np.quantile(ranks, covered))) if len(ranks) else 1


def rotation(dim: int, seed: int = 6) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)


_LISTED = pa.schema([("list", pa.int32()), ("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64())), ("copies", pa.int64())])


def _listed(vectors: DataFrame, index, dim: int, probes: int = 0) -> DataFrame:
    """Each vector with its list; with probes, a row for each list that it probes as a query."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: Index = index.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dim)
            if probes:
                order = np.argsort(_squares(x, at.centres), axis=1, kind="stable")
                enough = np.cumsum(at.sizes[order], axis=1) - at.sizes[order] < 64  # few vectors in the lists before
                row, rank = np.nonzero((np.arange(order.shape[1])[None] < probes) | enough)
                lists = order[row, rank]
            else:
                row, lists = np.arange(len(x)), at.nearest(x)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), taken.column(0), taken.column(1).cast(pa.list_(pa.float64())), taken.column(2)], schema=_LISTED)

    return vectors.select("vec_id", "embedding", "copies").mapInArrow(task, "list int, vec_id long, embedding array<double>, copies long")


#: query: a hash of the query's vector, which tells rows of one id apart; copies: equal query rows.
FOUND = "query_id long, query long, copies long, vec_id long, score double"
_FOUND = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("copies", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def scan(query: np.ndarray, turned_query: np.ndarray, x: np.ndarray, turned: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of x to the query, ties to the smaller id: (row numbers, distances)."""
    dim = x.shape[1]
    first = min(len(x), 4 * k)
    alive = np.arange(len(x))
    if len(x) > first:
        bound = np.partition(((turned[:first] - turned_query) ** 2).sum(axis=1), k - 1)[k - 1]
        partial = np.zeros(len(x))
        for at in range(0, dim, block):
            partial += ((turned[alive, at : at + block] - turned_query[at : at + block]) ** 2).sum(axis=1)
            seen = min(dim, at + block)
            if seen < dim:
                kept = partial <= bound * (seen / dim) * (1 + epsilon / seen**0.5) ** 2
            else:
                kept = partial <= bound * (1 + 1e-9) + 1e-12
            alive, partial = alive[kept], partial[kept]
            if len(alive) > 4 * k and seen < dim and at:  # a tighter bound from the most promising ones
                some = alive[np.argpartition(partial, 2 * k)[: 2 * k]]
                bound = min(bound, np.partition(((turned[some] - turned_query) ** 2).sum(axis=1), k - 1)[k - 1])
    score = np.sqrt(((x[alive] - query) ** 2).sum(axis=1))
    order = np.lexsort((ids[alive], score))[:k]
    return alive[order], score[order]


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found of every query, by Euclidean distance.

    is_query: tells the rows of vectors that are queries too.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.filter(F.col(id_column).isNotNull() & sound(F.col(vector_column))).select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("embedding"), is_query.alias("asked"))
    by_dim = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if by_dim is None:
        return spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in (("query_id", "long"), ("rank", "int"), ("vec_id", "long"), ("score", "double"))))
    dim, total = by_dim["dim"], by_dim["count"]
    rows = rows.filter(F.size("embedding") == dim)
    if rows.groupBy("vec_id").count().filter("count > 1").isEmpty():
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    else:
        rows = rows.groupBy("vec_id", "embedding", "asked").agg(F.count(F.lit(1)).alias("copies"))
    picked = rows.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    sample = np.array(picked["embedding"].tolist(), np.float64)
    at = Index(centres(sample, max(1, min(MOST_LISTS, round(total**0.5)))), rotation(dim), np.zeros(0))
    index = spark.sparkContext.broadcast(at)
    candidates = _listed(rows, index, dim)
    sizes = candidates.groupBy("list").count().collect()  # a row for each list, MOST_LISTS at most
    at.sizes = np.zeros(len(at.centres), np.int64)
    for r in sizes:
        at.sizes[r["list"]] = r["count"]
    index = spark.sparkContext.broadcast(at)
    asked = _listed(rows.filter("asked"), index, dim, probes_for(sample, at.centres, k))
    probed = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}
    chunks = F.array(*(F.lit(int(-(-max(n, 1) // CHUNK))) for n in at.sizes))
    groups = F.array(*(F.lit(int(-(-max(probed.get(i, 0), 1) // QUERY_CHUNK))) for i in range(len(at.sizes))))
    own_chunk, own_group = F.pmod(F.xxhash64("vec_id", "embedding"), F.get(chunks, F.col("list"))), F.pmod(F.xxhash64("embedding"), F.get(groups, F.col("list")))
    all_chunks, all_groups = F.explode(F.sequence(F.lit(0), F.get(chunks, F.col("list")) - 1)), F.explode(F.sequence(F.lit(0), F.get(groups, F.col("list")) - 1))
    left = asked.select("list", own_group.cast("int").alias("group"), all_chunks.alias("chunk"), "vec_id", "embedding", "copies", F.xxhash64("embedding").alias("query"))
    right = candidates.filter(F.col("list").isin(sorted(probed))).select("list", own_chunk.cast("int").alias("chunk"), all_groups.alias("group"), "vec_id", "embedding", "copies")

    def meet(queries: pa.Table, others: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in _FOUND.names}
        if queries.num_rows and others.num_rows:
            turn = index.value.rotation
            ids, x, copies = others.column("vec_id").to_numpy(), _matrix(others.column("embedding"), dim), others.column("copies").to_numpy()
            order = np.repeat(np.arange(len(ids)), np.minimum(copies, k + 1))  # more of them are in no ranking
            order = order[np.argsort(ids[order], kind="stable")]
            ids, x = ids[order], x[order]
            turned = x @ turn
            q = _matrix(queries.column("embedding"), dim)
            for i, (query, at_q, turned_query) in enumerate(zip(queries.column("vec_id").to_pylist(), q, q @ turn, strict=True)):
                same = np.arange(np.searchsorted(ids, query, "left"), np.searchsorted(ids, query, "right"))
                same = same[(x[same] == at_q).all(axis=1)][:1]  # the query's own row, if it lies in this chunk
                rest = np.delete(np.arange(len(ids)), same) if len(same) else slice(None)
                found, score = scan(at_q, turned_query, x[rest], turned[rest], ids[rest], k)
                out["query_id"] += [query] * len(found)
                out["query"] += [queries.column("query")[i].as_py()] * len(found)
                out["copies"] += [queries.column("copies")[i].as_py()] * len(found)
                out["vec_id"] += ids[rest][found].tolist()
                out["score"] += score.tolist()
        return pa.Table.from_batches([batch_of(_FOUND, out)])

    keys = ("list", "chunk", "group")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("score", "vec_id"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    found = found.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))  # equal query rows have equal rankings
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
