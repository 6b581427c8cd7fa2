"""N-gram Jaccard join of documents by partition enumeration (PartEnum) signatures.

A document is its set of five-word shingles (64-bit hashes). Documents link when their sets' Jaccard
similarity is at least 80 %. Sizes fall into bands whose bounds grow by 5/4, so linked documents lie in one
band or in two next to each other; each band is an instance of the join, for its own documents and those
of the band below.

In an instance the feature domain is cut into n blocks of three parts. The signatures are all (block, subset
of two of its parts), each the hash of the set's features there. Two sets whose difference has at most h
features share at least 2n - h of these 3n signatures: a block without difference shares three, one with a
single difference still shares one. n is chosen above half the largest possible difference of the band. As at
least 2n - h signatures are shared, any n + h + 1 of a document's signatures, taken in one order for all
documents, are enough (the prefix principle). The order takes signatures of many features first, so those of
few features or none, which unrelated documents share, are left out wherever that is exact.

Signatures are dealt out by hash to buckets, packed; a bucket finds the runs of equal ones and hands on each
different set of members once, as links to the smallest member. These are verified on the whole sets, and
connected. Where a run still spans several components, its pairs across components are verified too, after an
exact bound on the difference from parity bit maps. So no link between different texts is lost, while
a group of copies costs a star and not all its pairs. Equal sets are one class from the start.

Rows are told apart by a key of their own: the doc_id, where all rows with it hold one text; else a hash of doc_id
and text, which is checked to be no other row's key.

Defined cases: a text with fewer than five words is one shingle; a null or empty text, or one without words,
has none and links with nothing; every row is a document, also where ids repeat: rows of one id and different
texts have a set and links each, and link with each other only if they are alike; a component is named by its
smallest doc_id that is not null, rows of null ids alone by null; an empty table gives no rows; further columns
are ignored. Hash values stand for shingles: two different ones of a pair agree with probability 2**-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import batch_of, bounded_batches, few, fresh, light, text_of, written

WORDS = 5
#: Documents link from this similarity on, in percent; the bands' growth of 5/4 goes with it.
PERCENT = 80
#: Characters of text behind the signatures of one bucket, at about, and buckets at least.
BUCKET_CHARS, LEAST_BUCKETS = 8_000_000, 32
#: A document's own row weighs about as much in its bucket as so many characters of text.
ROW_CHARS = 100
#: Signatures that a task gathers before it hands them on, and documents.
FLUSH, FLUSH_DOCS = 2_000_000, 60_000
#: Members verified against one hub in one group.
GROUP = 48
#: Runs of a class that are listed with it, to form a pair in one run alone.
FIRST_RUNS = 128
#: Bits of the parity map: 64 for each of its columns.
MAP_WORDS = 8

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted hashes of the text's set; A-Z are lower-cased, words lie between ASCII white space."""
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(h))
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        acc = (acc ^ h[j : len(h) - width + 1 + j]) * _A
        acc ^= acc >> np.uint64(32)
    return np.unique(_mixed(acc))


def _bounds() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 5 // 4 + 1)
    return np.array(out)


BOUNDS = _bounds()


def plan(instance: int) -> int:
    """Blocks of an instance: more than half the largest difference of linked sets in it."""
    largest = (2 * (int(BOUNDS[instance + 1]) - 1)) // 9
    return (largest + 1 + 1) // 2 + 1 + largest // 32


def signatures(s: np.ndarray, instance: int, most: int) -> np.ndarray:
    """The signatures that a set hands on in an instance. most: its largest partner there."""
    n, blocks = len(s), plan(instance)
    part = ((s >> np.uint64(32)) * np.uint64(3 * blocks)) >> np.uint64(32)
    at = np.searchsorted(part, np.arange(3 * blocks + 1, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(s + _A))])
    own, count = (sums[at[1:]] - sums[at[:-1]]).reshape(-1, 3), np.diff(at).reshape(-1, 3)
    two, counts = own.sum(axis=1, keepdims=True, dtype=np.uint64) - own, count.sum(axis=1, keepdims=True) - count
    number = np.arange(3 * blocks, dtype=np.uint64) + np.uint64(instance << 40)
    signature = _mixed(two.ravel() + _mixed(number + _B))
    difference = min((n + most) // 9, 2 * blocks - 1)
    needed = min(3 * blocks, blocks + difference + 1)
    if needed < 3 * blocks:
        order = (np.uint64(63) - np.minimum(counts.ravel(), 63).astype(np.uint64) << np.uint64(58)) | (signature >> np.uint64(6))
        signature = signature[np.argpartition(order, needed - 1)[:needed]]
    return signature


def all_signatures(s: np.ndarray) -> np.ndarray:
    """In the set's own band, and in the next one where a partner may lie there."""
    n = len(s)
    band = int(np.searchsorted(BOUNDS, n, "right")) - 1
    top = int(BOUNDS[band + 1]) - 1
    largest = n * 5 // 4
    own = signatures(s, band, min(top, largest))
    return own if largest <= top else np.concatenate([own, signatures(s, band + 1, largest)])


def links_with_others(n: int) -> bool:
    """Whether a set of n features may link with a different one; equal ones are one class from the start."""
    return (n + n * 5 // 4) // 9 > 0


def parity(s: np.ndarray) -> np.ndarray:
    """Bit i of the map: the parity of the number of features with this hash; a difference flips one bit at most."""
    bits = np.bincount((s & np.uint64(64 * MAP_WORDS - 1)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


_MAP = [f"m{i}" for i in range(MAP_WORDS)]
_DOC = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), *((m, pa.int64()) for m in _MAP), ("docs", pa.binary()), ("owner", pa.binary()), ("signature", pa.binary())])
DEALT = "bucket int, doc_id long, n long, set_key binary, " + ", ".join(f"{m} long" for m in _MAP) + ", docs binary, owner binary, signature binary"


class Dealer:
    """Gathers one task's signatures and hands them on by bucket, with a row for each document."""

    def __init__(self, buckets: int):
        self.buckets, self.rows = buckets, 0
        self._clear()

    def _clear(self) -> None:
        self.ids: list[int] = []
        self.owners: list[np.ndarray] = []
        self.parts: list[np.ndarray] = []
        self.seen: set[bytes] = set()
        self.size = 0

    def row(self, **values) -> None:
        for name in _DOC.names:
            self.out[name].append(values.get(name))

    def add(self, doc_id: int, text: str) -> None:
        s = shingles(text)
        key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
        maps = {m: None for m in _MAP}
        new = len(s) and key not in self.seen
        if new:
            maps = dict(zip(_MAP, parity(s).tolist(), strict=True))
        # documents may lie in any bucket: dealt out by id and set, equal rows in turn
        self.rows += 1
        bucket = (xxhash.xxh3_64_intdigest(key + doc_id.to_bytes(8, "little", signed=True)) + self.rows) % self.buckets
        self.row(bucket=bucket, doc_id=doc_id, n=len(s), set_key=key, **maps)
        if new:
            self.seen.add(key)
        if new and links_with_others(len(s)):
            found = all_signatures(s)
            self.owners.append(np.full(len(found), len(self.ids), np.uint16))
            self.parts.append(found)
            self.ids.append(doc_id)
            self.size += len(found)

    def flush(self) -> None:
        if self.size:
            ids = np.array(self.ids, np.int64)
            signature, owner = np.concatenate(self.parts), np.concatenate(self.owners)
            bucket = (signature >> np.uint64(32)) % np.uint64(self.buckets)
            order = np.argsort(bucket, kind="stable")
            signature, owner, bucket = signature[order].astype(np.uint32), owner[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(bucket)], strict=True):
                used, local = np.unique(owner[a:b], return_inverse=True)
                self.row(bucket=int(bucket[a]), docs=ids[used].tobytes(), owner=local.astype(np.uint16).tobytes(), signature=signature[a:b].tobytes())
        self._clear()

    def batches(self, texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        self.out: dict[str, list] = {n: [] for n in _DOC.names}
        for batch in texts:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                self.add(doc_id, text.as_py())
                if self.size >= FLUSH or len(self.ids) >= FLUSH_DOCS:
                    self.flush()
            yield batch_of(_DOC, self.out)
            self.out = {n: [] for n in _DOC.names}
        self.flush()
        yield batch_of(_DOC, self.out)


#: kind d: a document (a: id, n, set_key, map); p: a pair a < b that shares a signature; r: document b in run a.
_MET = pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), *((m, pa.int64()) for m in _MAP)])
MET = "kind string, a long, b long, n long, set_key binary, " + ", ".join(f"{m} long" for m in _MAP)


def runs(signature: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run number and member of all runs of equal signatures with several members, each different set of members once."""
    order = np.lexsort((doc, signature))
    signature, doc = signature[order], doc[order]
    fresh = np.r_[True, (signature[1:] != signature[:-1]) | (doc[1:] != doc[:-1])]
    signature, doc = signature[fresh], doc[fresh]
    first = np.flatnonzero(np.r_[True, signature[1:] != signature[:-1]])
    size = np.diff(np.r_[first, len(signature)])
    if not len(first) or size.max() < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    members = np.add.reduceat(_mixed(doc.astype(np.uint64) + _C), first)
    several = np.flatnonzero(size > 1)
    _, kept = np.unique(np.stack([members[several], size[several].astype(np.uint64)], axis=1), axis=0, return_index=True)
    kept = several[np.sort(kept)]
    number = np.repeat(kept, size[kept])
    at = np.arange(len(number)) - np.repeat(np.cumsum(size[kept]) - size[kept], size[kept]) + np.repeat(first[kept], size[kept])
    return number, doc[at]


def _meet(table: pa.Table) -> pa.Table:
    """One bucket: passes on its documents, finds the runs of its signatures."""
    kinds = pa.compute.is_valid(table.column("signature"))
    documents, dealt = table.filter(pa.compute.invert(kinds)), table.filter(kinds)
    out = [pa.Table.from_arrays([pa.array(["d"] * documents.num_rows, pa.string()), documents.column("doc_id"), pa.nulls(documents.num_rows, pa.int64()), documents.column("n"), documents.column("set_key"), *(documents.column(m) for m in _MAP)], schema=_MET)]
    if dealt.num_rows:
        signature = np.concatenate([np.frombuffer(x, np.uint32) for x in dealt.column("signature").to_pylist()])
        doc = np.concatenate([np.frombuffer(d, np.int64)[np.frombuffer(o, np.uint16)] for d, o in zip(dealt.column("docs").to_pylist(), dealt.column("owner").to_pylist(), strict=True)])
        number, member = runs(signature, doc)
        first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(number)])
        hub = np.repeat(member[first], size)  # members are in order: the smallest
        pairs = np.unique(np.stack([hub, member], axis=1)[hub != member], axis=0)
        large = np.repeat(size > 2, size)
        bucket = int(dealt.column("bucket")[0].as_py())
        for kind, a, b in (("p", pairs[:, 0], pairs[:, 1]), ("r", number[large] + (bucket << 32), member[large])):
            out.append(pa.Table.from_arrays([pa.array([kind] * len(a), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.nulls(len(a), f.type) for f in list(_MET)[3:])], schema=_MET))
    return pa.concat_tables(out)


VERIFIED = "a long, b long, linked boolean"
_VERIFIED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])


def _verify(table: pa.Table) -> pa.Table:
    """One hub and some members, on their whole texts."""
    sets = [(r["member"], shingles(r["text"])) for r in table.to_pylist()]
    hub = table.column("hub")[0].as_py()
    centre = next(s for m, s in sets if m is None)
    found = []
    for member, s in sets:
        if member is not None:
            both = len(np.intersect1d(centre, s, assume_unique=True))
            found.append((hub, member, 100 * both >= PERCENT * (len(centre) + len(s) - both)))
    return pa.Table.from_arrays([pa.array([x[i] for x in found], f.type) for i, f in enumerate(_VERIFIED)], schema=_VERIFIED)


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, linked of pairs (a: hub, b: member), in groups of about GROUP members with their hub's text."""
    # hubs of many members are cut into parts; of the others no count has to be joined
    parts = F.ceil(F.count(F.lit(1)) / GROUP).cast("long").alias("parts")
    large = few(pairs.groupBy(F.col("a").alias("large")).agg(parts).filter("parts > 1"), "hubs")
    members = pairs.join(large, pairs["a"] == large["large"], "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    hubs = members.select("a", "part").distinct()
    routes = members.select(F.col("b").alias("id"), F.col("a").alias("hub"), "part", F.col("b").alias("member")).unionByName(hubs.select(F.col("a").alias("id"), F.col("a").alias("hub"), "part", F.lit(None).cast("long").alias("member")))
    routes = few(routes, "routes")  # few ones go to the texts, so that these are shuffled to their groups alone
    return texts.join(routes, "id").select("hub", "part", "member", "text").groupBy("hub", "part").applyInArrow(_verify, VERIFIED)


def components(edges: DataFrame) -> DataFrame:
    """id and component (its smallest reachable id) of all ends of edges (a, b), by smallest neighbours and jumps."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    while True:
        labels = light(labels)  # where they are few, a hub of many edges is no one task's work
        near = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        jump = step.select(F.col("id").alias("to"), F.col("component").alias("further"))
        step = step.join(jump, step["component"] == jump["to"], "left").select("id", F.least("component", F.coalesce("further", "component")).alias("component"), "before")
        step = written(step, "labels")
        changed = step.filter("component < before").limit(1).count()
        labels = step.select("id", "component")
        if not changed:
            return labels


def keyed(documents: DataFrame) -> tuple[DataFrame, str, DataFrame | None, int]:
    """(documents with every row's key, its column, keys and doc_ids where some key is no doc_id, characters in all).

    Rows of equal doc_id and text share a key.
    """
    key, key_id, key_shared = fresh(documents, "_jaccard_key", "_key_id", "_key_shared")
    own, mark = F.col("doc_id").cast("long"), F.xxhash64(text_of())
    by_id = documents.groupBy(own.alias("_id")).agg(F.min(mark).alias("low"), F.max(mark).alias("high"), F.sum(F.char_length(text_of()) + ROW_CHARS).alias("chars"))
    shared = F.col("_id").isNull() | (F.col("low") != F.col("high"))
    chars, n_shared = by_id.agg(F.sum("chars"), F.count_if(shared)).first()
    if not n_shared:
        return documents.withColumn(key, own), key, None, chars or 0
    several = few(by_id.filter(shared).select(F.col("_id").alias(key_id), F.lit(True).alias(key_shared)), "shared")
    rows = documents.join(several, own.eqNullSafe(F.col(key_id)), "left")
    for seed in range(64):
        numbered = rows.withColumn(key, F.when(F.col(key_shared), F.xxhash64(F.lit(seed), own, mark)).otherwise(own)).drop(key_id, key_shared)
        texts = numbered.groupBy(key).agg(F.min(F.struct(own, mark)).alias("low"), F.max(F.struct(own, mark)).alias("high"))
        if texts.filter(~F.col("low").eqNullSafe(F.col("high"))).isEmpty():
            return numbered, key, written(numbered.select(F.col(key).alias("id"), own.alias("doc_id")).distinct(), "names"), chars
    raise ValueError("no seed gives every row a key of its own")


def join(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    rows, key, names, chars = keyed(documents)
    found = _join(rows.select(F.col(key).alias("id"), text_of().alias("text")), chars)
    if names is None:
        return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    named = written(found.join(names, "id"), "named")
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "component").select("doc_id", "n_shingles", "component_id")


def _join(rows: DataFrame, chars: int) -> DataFrame:
    """id, n_shingles and component (the smallest id reachable) of every row. rows: id, text."""
    spark = rows.sparkSession
    bounded_batches(spark)
    buckets = max(LEAST_BUCKETS, chars // BUCKET_CHARS)
    dealt = rows.mapInArrow(lambda batches: Dealer(buckets).batches(batches), DEALT)
    met = written(dealt.repartition(int(buckets), "bucket").groupBy("bucket").applyInArrow(_meet, MET), "met")
    docs = met.filter("kind = 'd'")
    # sets of several documents; any other document is a class of its own
    several = docs.filter("n > 0").groupBy("set_key").agg(F.min("a").alias("class"), F.count(F.lit(1)).alias("size"), *(F.min(m).alias(f"{m}_all") for m in _MAP))
    several = few(several.filter("size > 1").drop("size"), "several")
    maps = [F.coalesce(f"{m}_all", m).alias(m) for m in _MAP]
    own = F.coalesce("class", F.when(F.col("n") > 0, F.col("a")))
    member = written(docs.join(several, "set_key", "left").select(F.col("a").alias("id"), "n", own.alias("class"), *maps), "classes")
    named = member.filter("n > 0").select("id", "class").distinct()
    pairs = met.filter("kind = 'p'").select("a", "b").distinct()
    pairs = _in_classes(pairs, named)
    texts = rows
    links = written(verified(texts, written(pairs, "pairs")), "links")
    found = components(links.filter("linked").select("a", "b"))
    # runs that span several components: their pairs across components, within the sizes' and maps' bounds
    place = F.coalesce(F.col("component"), F.col("class"))
    held = met.filter("kind = 'r'").select(F.col("a").alias("run"), F.col("b").alias("id")).join(named, "id").select("run", "class").distinct()
    held = held.join(found.withColumnRenamed("id", "class"), "class", "left").select("run", "class", place.alias("component"))
    wide = held.groupBy("run").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("run")
    facts = member.filter("id = class").dropDuplicates(["class"]).select("class", "n", *_MAP)
    rest = written(held.join(wide, "run", "left_semi"), "wide")
    first = rest.groupBy("class").agg(F.slice(F.sort_array(F.collect_list("run")), 1, FIRST_RUNS).alias("runs"))
    rest = written(rest.join(facts, "class").join(first, "class"), "rest")
    other = rest.select(F.col("run").alias("run2"), F.col("class").alias("class2"), F.col("component").alias("component2"), F.col("n").alias("n2"), F.col("runs").alias("runs2"), *(F.col(m).alias(f"{m}2") for m in _MAP))
    flips = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"{m}2"))) for m in _MAP), F.lit(0))
    near = (F.col("component") < F.col("component2")) & (5 * F.least("n", "n2") >= 4 * F.greatest("n", "n2")) & (9 * flips <= F.col("n") + F.col("n2"))
    # a pair is formed in the first run that both lie in; where that is beyond the lists kept, in all of them
    common = F.array_min(F.array_intersect("runs", "runs2"))
    near = near & (F.coalesce(common, F.col("run")) == F.col("run"))
    across = rest.join(other, (F.col("run") == F.col("run2")) & near).select(F.least("class", "class2").alias("a"), F.greatest("class", "class2").alias("b")).distinct()
    across = written(across.join(links.select("a", "b"), ["a", "b"], "left_anti"), "across")
    more = written(verified(texts, across).filter("linked").select("a", "b"), "more")
    if not more.isEmpty():
        found = components(links.filter("linked").select("a", "b").unionByName(more))
    out = member.join(light(found.withColumnRenamed("id", "class")), "class", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "class", "id").alias("component"))


def _in_classes(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs of documents as pairs of their classes, each once."""
    left = named.select(F.col("id").alias("a"), F.col("class").alias("class_a"))
    right = named.select(F.col("id").alias("b"), F.col("class").alias("class_b"))
    out = pairs.join(left, "a").join(right, "b").filter("class_a <> class_b")
    return out.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct()


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents that are the first (smallest doc_id) of their component, in their own columns.

    Documents without words stay, each. Of rows of equal doc_id and text one stays; of a component that knows
    no doc_id one row.
    """
    rows, key, names, chars = keyed(documents)
    found = _join(rows.select(F.col(key).alias("id"), text_of().alias("text")), chars)
    place = found
    if names is not None:
        place = written(found.distinct().join(names, "id"), "place")
        first = place.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("id")))["id"].alias("_first")).select("_first")
        place = place.drop("component").join(first, F.col("id") == F.col("_first"), "left").withColumnRenamed("_first", "component")
    chosen = place.filter((F.col("id") == F.col("component")) | (F.col("n_shingles") == 0)).select(F.col("id").alias(key)).distinct()
    kept = rows.join(chosen, key, "left_semi")
    if not found.filter("n_shingles > 0").groupBy("id").count().filter("count > 1").isEmpty():  # repeated rows
        row = F.struct(*documents.columns)
        words = text_of().rlike(r"[^\x20\x09-\x0D]")
        one = kept.filter(words).groupBy(key).agg(F.min(F.struct(F.xxhash64(F.to_json(row)), row))["col2"].alias("row")).select("row.*")
        return one.unionByName(kept.filter(~words).select(*documents.columns))
    return kept.select(*documents.columns)
