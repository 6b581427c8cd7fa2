r"""Conversation prefix trie by the Euler-tour technique.

Each distinct sequence of first turns is a node. Its key is 128 bits: over its turns, the exclusive or of a hash of
(place, role, text), so the keys of all beginnings of a conversation are running values that blocks of turns work out
apart from each other.

A node is named (conv_id, depth) by its smallest member. The nodes of one name lie on a path downwards, so only a
path's top needs to look for its parent. Every node has an arc that enters it and one that leaves it; the tour visits
a path's own child first, then the paths attached, by name. So a path's enter arcs are one run of the tour, and its exit arcs
are runs that begin at its end and at each node with paths attached. The list of runs is ranked: every run jumps along pointers
of doubling length until it reaches a splitter, one run in ``SPLIT`` by hash; the splitters are a list of
the same kind, ranked in the same way, until the list has at most ``FEW`` runs, which one task walks. A run's
place gives those of its arcs. Prefix sums of leaves and savings over the arcs' places, blocks first, then
within each, give every subtree's as the difference between its exit and its enter arc.

No step holds a whole conversation, list of children, or tour in one task: turns and siblings are numbered by ranges, blocks first,
and only rows of a block boundary are looked up. The one exception is the digest of a node's last members, which are
hashed in order, a row at a time.

Defined cases: a null role or text is empty; null turn numbers come first, equal ones go by role, then by the MD5 of the text;
repeated rows are repeated turns; rows with a null conv_id take part in no conversation; a conversation left
without turns ends at the root; an empty table has no node, not even the root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake.llm.common import batch_of, bounded_batches, few, light, text_of, written

#: One run in SPLIT is a splitter; a list of at most FEW runs is walked by one task.
SPLIT, FEW = 16, 100_000
#: Arcs in a block of the tour at least.
ARCS = 1 << 16
_WORD = r"[^\x20\x09-\x0D]+"
_KEY = ("depth", "ka", "kb")


def _blocks(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df written in ranges of the columns (nulls first), with the range's number in the column block."""
    return written(df.repartitionByRange(*order).withColumn("block", F.spark_partition_id()), name)


def _ahead(blocks: DataFrame, key: str, **sums: Column) -> DataFrame:
    """key, block, and for each name the sum (xor for names that begin with x) over the key's blocks before this one.

    Keys that lie in one block are left out: they have nothing ahead.
    """
    totals = blocks.groupBy(key, "block").agg(*(c.alias(n) for n, c in sums.items()))
    several = totals.groupBy(key).agg(F.count(F.lit(1)).alias("blocks")).filter("blocks > 1").select(key)
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = few(totals.join(several, key, "left_semi"), "several")  # boundaries of blocks alone
    running = {n: F.coalesce((F.bit_xor(n) if n.startswith("x") else F.sum(n)).over(before), F.lit(0).cast("long")) for n in sums}
    return totals.select(key, "block", *(c.alias(n) for n, c in running.items()))


# --- turns and nodes ---------------------------------------------------------------------------------


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), a, b (a hash of role and text), words, of every turn, and its block."""
    role = F.coalesce(F.col("role"), F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.md5(text_of().cast("binary")).alias("digest"),
        F.regexp_count(text_of(), F.lit(_WORD)).cast("long").alias("words"),
    )
    blocks = _blocks(rows, "turns", "conv_id", "turn", "role", "digest")
    ahead = _ahead(blocks, "conv_id", n=F.count(F.lit(1)))
    within = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "role", "digest"))
    a, b = F.xxhash64(F.lit(1), "role", "digest").alias("a"), F.xxhash64("role", "digest", F.lit(2)).alias("b")
    return blocks.withColumn("place", within).join(light(ahead), ["conv_id", "block"], "left").select("conv_id", "block", (F.col("place") + F.coalesce("n", F.lit(0))).alias("place"), a, b, "words")


def _mixed(depth: Column) -> list[Column]:
    """What a turn at this depth adds to the key."""
    return [F.xxhash64(depth.cast("long"), "a", "b").alias("xa"), F.xxhash64("b", depth.cast("long"), "a").alias("xb")]


def shared_first(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, block, a, b, words of rebuilt conversations.

    Conversation c begins with the first h = crc32(c) % 4 turns of conversation c - c % 20, then its own turns after
    its first h follow. A conversation without any turn has one row of depth 0.
    """
    turns = written(numbered(conversations), "numbered")
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    convs = convs.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int").alias("h"))
    firsts = turns.filter("place <= 3 AND conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "a", "b", "words")
    lent = convs.join(firsts, "base").filter("depth <= h").select("conv_id", "depth", F.lit(-1).alias("block"), "a", "b", "words")
    lengths = convs.join(firsts.groupBy("base").agg(F.count(F.lit(1)).alias("there")), "base", "left").select("conv_id", "h", "own", F.least("h", F.coalesce("there", F.lit(0))).alias("lent"))
    lengths = written(lengths, "lengths")
    own = turns.join(lengths.select("conv_id", "h", "lent"), "conv_id").filter("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("depth"), "block", "a", "b", "words")
    null = F.lit(None).cast("long")
    bare = lengths.filter("own <= h AND lent = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(-1).alias("block"), null.alias("a"), null.alias("b"), F.lit(0).cast("long").alias("words"))
    return lent.unionByName(own).unionByName(bare)


def members(turns: DataFrame) -> DataFrame:
    """conv_id, depth, ka, kb, pa, pb (the node's key and its parent's), words: every conversation's place in every node.

    turns: conv_id, depth from 1 (0 where a conversation has no turn), block, a, b, words. The turns of a
    conversation are in blocks, in any number of them, higher ones deeper.
    """
    mixed = written(turns.filter("depth > 0").select("conv_id", "depth", "block", "words", *_mixed(F.col("depth"))), "mixed")
    ahead = _ahead(mixed, "conv_id", xa=F.bit_xor("xa"), xb=F.bit_xor("xb")).select("conv_id", "block", F.col("xa").alias("aa"), F.col("xb").alias("ab"))
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = mixed.select("*", F.bit_xor("xa").over(within).alias("ra"), F.bit_xor("xb").over(within).alias("rb")).join(light(ahead), ["conv_id", "block"], "left")
    key = lambda own, before: F.col(own).bitwiseXOR(F.coalesce(before, F.lit(0).cast("long")))
    rows = rows.select("conv_id", "depth", key("ra", "aa").alias("ka"), key("rb", "ab").alias("kb"), "xa", "xb", "words")
    rows = rows.select("conv_id", F.col("depth").cast("long").alias("depth"), "ka", "kb", F.col("ka").bitwiseXOR(F.col("xa")).alias("pa"), F.col("kb").bitwiseXOR(F.col("xb")).alias("pb"), "words")
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = turns.select("conv_id").distinct().select("conv_id", zero.alias("depth"), zero.alias("ka"), zero.alias("kb"), null.alias("pa"), null.alias("pb"), zero.alias("words"))
    return rows.unionByName(roots)


ENDS = "depth long, ka long, kb long, ends_sha256 string"
_ENDS = pa.schema([("depth", pa.int64()), ("ka", pa.int64()), ("kb", pa.int64()), ("ends_sha256", pa.string())])


def ends(rows: DataFrame) -> DataFrame:
    """Per key at which conversations end: the SHA-256 of their ids, ascending and comma-joined, hashed as a stream."""
    bounded_batches(rows.sparkSession)
    last = rows.groupBy("conv_id").agg(F.max(F.struct(*_KEY)).alias("last")).select("last.*", "conv_id")
    last = last.repartition(*_KEY).sortWithinPartitions(*_KEY, "conv_id")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hashed = None, None
        for batch in batches:
            out: list[tuple] = []
            for *new, conv in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if new != key:
                    if hashed:
                        out.append((*key, hashed.hexdigest()))
                    key, hashed = new, hashlib.sha256(str(conv).encode())
                else:
                    hashed.update(f",{conv}".encode())
            yield batch_of(_ENDS, dict(zip(_ENDS.names, map(list, zip(*out)))) if out else {n: [] for n in _ENDS.names})
        if hashed:
            yield batch_of(_ENDS, dict(zip(_ENDS.names, [[k] for k in (*key, hashed.hexdigest())], strict=True)))

    return last.mapInArrow(task, ENDS)


# --- the tour ----------------------------------------------------------------------------------------


def runs(paths: DataFrame, attached: DataFrame) -> DataFrame:
    """The tour as a list of runs: c, s (-1 for the enter arcs, else the depth of the first exit), w arcs, nc, ns (the next run).

    paths: conv_id, top, end (depths). attached: conv_id, pc, pd of every path but the root's: the node that it hangs on.
    """
    blocks = _blocks(attached, "siblings", "pc", "pd", "conv_id")
    edge = blocks.groupBy("pc", "pd", "block").agg(F.min("conv_id").alias("first"))
    node = Window.partitionBy("pc", "pd")
    edge = few(edge.withColumn("blocks", F.count(F.lit(1)).over(node)).withColumn("later", F.lead("first").over(node.orderBy("block"))).filter("blocks > 1"), "edges").select("pc", "pd", "block", "later")
    inside = F.lead("conv_id").over(Window.partitionBy("pc", "pd", "block").orderBy("conv_id"))
    hangs = written(blocks.withColumn("next", inside).join(edge, ["pc", "pd", "block"], "left").select("conv_id", "pc", "pd", F.coalesce("next", "later").alias("next")), "hangs")
    first = hangs.groupBy("pc", "pd").agg(F.min("conv_id").alias("first"))
    # nodes at which a run of exits begins: a path's end and those with paths attached
    starts = paths.select(F.col("conv_id").alias("pc"), F.col("end").alias("pd"), F.lit(None).cast("long").alias("first")).unionByName(first)
    starts = starts.groupBy("pc", "pd").agg(F.min("first").alias("first"))
    up = Window.partitionBy("pc").orderBy("pd")
    lower = starts.select("pc", "pd", "first", F.lag("pd").over(up).alias("above"), F.lag("first").over(up).alias("above_first"))
    rows = lower.join(paths.select(F.col("conv_id").alias("pc"), "top", "end"), "pc")
    rows = written(rows, "starts")
    enters = rows.filter("pd = end").select(F.col("pc").alias("c"), F.lit(-1).cast("long").alias("s"), (F.col("end") - F.col("top") + 1).alias("w"), F.coalesce("first", "pc").alias("nc"), F.when(F.col("first").isNull(), F.col("pd")).otherwise(-1).alias("ns"))
    on = hangs.select(F.col("conv_id").alias("pc"), F.col("pc").alias("hc"), F.col("pd").alias("hd"), "next")
    within = rows.filter("above IS NOT NULL").select(F.col("pc").alias("c"), F.col("pd").alias("s"), (F.col("pd") - F.col("above")).alias("w"), F.col("above_first").alias("nc"), F.lit(-1).cast("long").alias("ns"))
    out = rows.filter("above IS NULL").join(on, "pc", "left").select(F.col("pc").alias("c"), F.col("pd").alias("s"), (F.col("pd") - F.col("top") + 1).alias("w"), F.coalesce("next", "hc").alias("nc"), F.when(F.col("next").isNull(), F.col("hd")).otherwise(-1).alias("ns"))  # the root's last run has no next one
    return enters.unionByName(within).unionByName(out)


def _splits(c: Column, s: Column, level: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), c, s), F.lit(SPLIT)) == 0


AFTER = "c long, s long, after long"
_AFTER = pa.schema([("c", pa.int64()), ("s", pa.int64()), ("after", pa.int64())])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A list of at most FEW elements in one task, from its end back."""
    before = {(nc, ns): (c, s, w) for batch in batches for c, s, w, nc, ns in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)}
    found, total, at = [], 0, before.get((None, None))
    while at is not None:
        c, s, w = at
        total += w
        found.append((c, s, total))
        at = before.get((c, s))
    yield batch_of(_AFTER, {name: [x[k] for x in found] for k, name in enumerate(_AFTER.names)})


def ranked(rows: DataFrame, most: int = FEW, level: int = 0) -> DataFrame:
    """c, s, after of a list c, s, w, nc, ns: the weights from each element to the list's end, its own included."""
    n = rows.count()
    if n <= most:
        return rows.select("c", "s", "w", "nc", "ns").coalesce(1).mapInArrow(_walk, AFTER)
    there = F.col("nc").isNull() | _splits(F.col("nc"), F.col("ns"), level)
    rows = rows.withColumn("there", there)
    while not rows.filter("NOT there").isEmpty():
        target = rows.select(F.col("c").alias("nc"), F.col("s").alias("ns"), F.col("w").alias("more"), F.col("nc").alias("fc"), F.col("ns").alias("fs"))
        moved = rows.filter("NOT there").join(target, ["nc", "ns"]).select("c", "s", (F.col("w") + F.col("more")).alias("w"), F.col("fc").alias("nc"), F.col("fs").alias("ns"))
        rows = written(rows.filter("there").unionByName(moved.withColumn("there", there)), "jumps")
    splitters = rows.filter(_splits(F.col("c"), F.col("s"), level)).drop("there")
    further = ranked(splitters, most, level + 1).select(F.col("c").alias("nc"), F.col("s").alias("ns"), F.col("after").alias("more"))
    return written(rows.join(further, ["nc", "ns"], "left").select("c", "s", (F.col("w") + F.coalesce("more", F.lit(0))).alias("after")), "ranks")


def trie(turns: DataFrame, most: int = FEW) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: as members takes them.
    """
    rows = written(members(turns), "members")
    found = rows.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("words").alias("words"), F.first("pa").alias("pa"), F.first("pb").alias("pb"))
    nodes = written(found.join(ends(rows), list(_KEY), "left"), "nodes")
    paths = written(nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "pa", "pb")).alias("first"), F.max("depth").alias("end")).select("conv_id", F.col("first.depth").alias("top"), "end", "first.pa", "first.pb"), "paths")
    parents = nodes.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), (F.col("depth") + 1).alias("top"), F.col("conv_id").alias("pc"), F.col("depth").alias("pd"))
    attached = written(paths.filter("top > 0").join(parents, ["pa", "pb", "top"]).select("conv_id", "pc", "pd"), "attached")
    places = runs(paths, attached)
    places = written(places, "runs")
    total = 2 * nodes.count()
    ranks = ranked(places, most).select("c", "s", (F.lit(total) - F.col("after")).alias("start"))
    starts = written(places.select("c", "s", "w").join(ranks, ["c", "s"]), "tour")
    # the arcs of each run: enter arcs go down from the path's top, exit arcs up from the run's depth
    tops = paths.select(F.col("conv_id").alias("c"), "top")
    step = F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1)).alias("k", "_k")
    arcs = starts.join(tops, "c").select("c", "s", "start", "top", step)
    enter = F.col("s") < 0
    arcs = arcs.select(F.col("c").alias("conv_id"), F.when(enter, F.col("top") + F.col("k")).otherwise(F.col("s") - F.col("k")).alias("depth"), (F.col("start") + F.col("k")).alias("at"), enter.alias("enter"))
    hanging = attached.groupBy(F.col("pc").alias("conv_id"), F.col("pd").alias("depth")).agg(F.count(F.lit(1)).alias("hanging"))
    own = nodes.join(paths.select("conv_id", "top", "end"), "conv_id").join(hanging, ["conv_id", "depth"], "left").join(attached.withColumnRenamed("pc", "hc").drop("pd"), "conv_id", "left")
    parent = F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("hc"))
    children = F.coalesce("hanging", F.lit(0).cast("long")) + (F.col("depth") < F.col("end")).cast("long")
    own = written(own.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", children.alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")), "own")
    sized = arcs.join(own.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), "saved"), ["conv_id", "depth"])
    # prefix sums over the tour: blocks of arcs first, then within each
    size = max(ARCS, isqrt(total))
    counted = F.when(F.col("enter"), F.col("leaf")).otherwise(0), F.when(F.col("enter"), F.col("saved")).otherwise(0)
    sized = written(sized.select("conv_id", "depth", "at", "enter", counted[0].alias("leaf"), counted[1].alias("saved"), F.expr(f"at div {size}").alias("stretch")), "arcs")
    stretches = sized.groupBy("stretch").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    before = Window.partitionBy(F.lit(1)).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # at most the root of the arcs
    stretches = stretches.select("stretch", F.coalesce(F.sum("leaf").over(before), F.lit(0)).alias("leaf_ahead"), F.coalesce(F.sum("saved").over(before), F.lit(0)).alias("saved_ahead"))
    within = Window.partitionBy("stretch").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sized.select("conv_id", "depth", "enter", "leaf", "saved", "stretch", F.sum("leaf").over(within).alias("leaf_to"), F.sum("saved").over(within).alias("saved_to")).join(stretches, "stretch")
    sign = F.when(F.col("enter"), -1).otherwise(1)
    # through the exit arc, less what lay before the enter arc
    upto = lambda name: F.sum(sign * (F.col(f"{name}_ahead") + F.col(f"{name}_to")) + F.col(name))
    subtrees = sums.groupBy("conv_id", "depth").agg(upto("leaf").alias("n_leaves"), upto("saved").alias("saved_tokens"))
    return own.join(subtrees, ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
