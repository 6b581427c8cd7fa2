"""Document fingerprints: one-permutation MinHash, in DataFrame expressions only.

Each five-word shingle is hashed once; its top bits choose one of ``BINS`` bins and each bin keeps its
smallest hash. An empty bin borrows from the filled bin that comes first in the empty bin's own random order
of all bins (optimal densification: each filled bin is as likely a lender, and two documents that have the
lender alike borrow alike). Of every bin the lowest ``BITS`` bits are stored, as one hexadecimal digit each.
Two fingerprints agree in a bin by chance with probability 2**-BITS; ``likeness`` corrects for that.

Words are lower-cased and lie between runs of space, tab, line ends, \\v and \\f. A text of fewer words
than a shingle has counts as one shingle; one without words as one fixed shingle.

Defined cases: a null text is the empty one; equal texts have equal fingerprints; equal ids are ordered by a
hash of their text, then by text; a null id counts as the smallest number; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake.llm.common import text_of

WORDS = 5
BINS, BITS = 128, 4
#: Rows that a range holds at about; blocks of ranges, and ranges in a slice of a block, at most.
RANGE_ROWS, MOST_BLOCKS, MOST_PARTS = 4000, 32768, 16
_TOP = BINS.bit_length() - 1


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the column name: the fingerprint's bins as sorted numbers bin * 2**BITS + low bits.

    The steps are columns of their own, each used more than once by the next, so that none is worked out
    again for every element.
    """
    words, hashes, least = f"_{name}_words", f"_{name}_hashes", f"_{name}_least"
    w = F.col(words)
    shingles = F.transform(F.sequence(F.lit(1), F.size(w) - (WORDS - 1)), lambda i: F.xxhash64(F.slice(w, i, WORDS)))
    mark = F.lit((1 << BITS) - 1).cast("long")

    def bin_of(h: Column) -> Column:
        return F.shiftright(h, 64 - _TOP)

    h, m = F.col(hashes), F.col(least)
    lenders = F.array_except(F.sequence(F.lit(-(BINS // 2)).cast("long"), F.lit(BINS // 2 - 1).cast("long")), F.transform(m, bin_of))

    def borrowed(b: Column) -> Column:
        # the order of the filled bins, as b has it, with the lender's low bits set into the order's own
        order = F.transform(m, lambda x: F.xxhash64(b, bin_of(x)).bitwiseAND(F.lit(-(1 << BITS)).cast("long")).bitwiseOR(x.bitwiseAND(mark)))
        return F.shiftleft(b, BITS).bitwiseOR(F.array_min(order).bitwiseAND(mark))

    filled = F.transform(m, lambda x: F.shiftleft(bin_of(x), BITS).bitwiseOR(x.bitwiseAND(mark)))
    return (
        df.withColumn(words, F.filter(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), lambda x: x != ""))
        .withColumn(hashes, F.sort_array(F.when(F.size(w) >= WORDS, shingles).otherwise(F.array(F.xxhash64(w)))))
        .withColumn(least, F.filter(h, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(h, F.greatest(i - 1, F.lit(0)))))))
        .withColumn(name, F.sort_array(F.concat(filled, F.transform(lenders, borrowed))))
        .drop(words, hashes, least)
    )


def packed(bins: Column) -> Column:
    """The low bits of all bins in order, a hexadecimal digit for each."""
    return F.array_join(F.transform(bins, lambda x: F.substring(F.lit("0123456789abcdef"), (x.bitwiseAND(F.lit((1 << BITS) - 1).cast("long")) + 1).cast("int"), F.lit(1))), "")


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard similarity estimated from two fingerprints' bins, 0 to 1."""
    chance = 1 / (1 << BITS)
    return F.greatest(F.lit(0.0), (F.size(F.array_intersect(a, b)) / BINS - chance) / (1 - chance))


def with_next(documents: DataFrame, range_rows: int = RANGE_ROWS, most: int = MOST_BLOCKS) -> DataFrame:
    """doc_id, text, whether the row is a copy, and its range: block, slice, part; copies close their ranges.

    Rows are dealt out by ranges of (doc_id, hash of text), each also getting a copy of the first row of the next
    one (the last range that of the first), so no task sees more than its range. An id that fills several blocks is
    cut by the hashes of its texts. Only the bounds of the blocks, at most ``most`` numbers, reach the driver; where
    blocks would hold more than ``range_rows`` rows, each is cut into parts by its own bounds. Rows of one id that
    fill less than a block, and rows alike in id and text, stay in one range.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumns({"key": F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")), "hash": F.shiftrightunsigned(F.xxhash64("text"), 1)})
    wanted = max(1, rows.count() // range_rows)
    blocks = min(most, wanted)
    found = rows.agg(F.percentile_approx("key", [i / blocks for i in range(1, blocks)], max(10_000, 10 * blocks))).first()[0] if blocks > 1 else []
    bounds = Counter(found)
    order = sorted(bounds)
    rows = rows.withColumns({"block": _range(F.col("key"), order), "slice": F.lit(0), "at": F.col("key")})
    if any(n > 1 for n in bounds.values()):
        # an id that is a bound n times has the rows of n blocks: these go by hash, the block's other ids behind them
        n = F.get(_numbers([1, *(bounds[k] for k in order)]), F.col("block"))
        hot = (n > 1) & (F.col("key") == F.get(_numbers([0, *order]), F.col("block")))
        rows = rows.withColumns({"slice": F.when(hot, F.shiftright(F.shiftright("hash", 39) * n, 24)).otherwise(n).cast("int"), "at": F.when(hot, F.col("hash")).otherwise(F.col("key"))})
    place = ["block", "slice", "part"]
    parts = min(MOST_PARTS, -(-wanted // blocks))
    if parts > 1:
        cuts = rows.groupBy("block", "slice").agg(F.percentile_approx("at", [i / parts for i in range(1, parts)]).alias("cuts"))
        rows = rows.join(F.broadcast(cuts), ["block", "slice"]).withColumn("part", F.size(F.filter("cuts", lambda x: x <= F.col("at"))))
    else:
        rows = rows.withColumn("part", F.lit(0))
    # the ranges, at most 2 * most * MOST_PARTS rows of numbers, in one row of order: each one's first row goes to the one before
    along = Window.orderBy(*place)
    here = F.struct(*place)
    before = F.coalesce(F.lag(here).over(along), F.last(here).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = rows.groupBy(*place).agg(F.min("at").alias("at")).select(*place, "at", before.alias("to"))
    copies = rows.join(F.broadcast(firsts), [*place, "at"]).groupBy("to").agg(F.min(F.struct("hash", "text")).alias("row"))
    copies = copies.select(F.lit(None).cast("long").alias("doc_id"), "row.text", F.lit(None).cast("long").alias("key"), "row.hash", F.lit(True).alias("copy"), *(F.col("to")[c].alias(c) for c in place))
    dealt = rows.select("doc_id", "text", "key", "hash", F.lit(False).alias("copy"), *place).unionByName(copies)
    return dealt.repartition(wanted, *place)


def _numbers(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _range(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the key, by halving."""
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    if not steps:
        return F.lit(0)
    numbers = _numbers(bounds)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when(F.get(numbers, low + step - 1) <= key, low + step).otherwise(low))


def fingerprints(documents: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and the likeness to this and to the next document.

    The edited text has the last quarter of the characters replaced by as many from the next document's start.
    """
    follow = Window.partitionBy("block", "slice", "part").orderBy("copy", "key", "hash", "text")
    rows = with_fingerprint(with_next(documents), "text", "bins")
    rows = rows.select("doc_id", "text", "bins", "copy", F.lead("text").over(follow).alias("next"), F.lead("bins").over(follow).alias("next_bins")).filter(~F.col("copy"))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "bins", "next_bins", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next"), F.lit(1), cut)).alias("edited"))
    rows = with_fingerprint(rows, "edited", "edited_bins")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"),
        packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
