"""Line dedup by a log-template tree.

A text is cut into lines, and these after sentence ends (a point, question or exclamation mark and a space), so
a passage that stands inside long lines recurs as its sentences. The parts, trimmed of spaces and line ends, are
parsed at a fixed depth: by token count (tokens lie between single spaces), then by their first ``LEADING``
tokens, tokens with a digit standing for any such token. Parts that agree so far lie in one leaf. Within a leaf a
position whose most common token makes up ``STEADY`` of the leaf's parts is fixed, any other is a variable field;
if at least ``FIXED`` of the positions after the leading ones are fixed, the parts that have all fixed tokens share
the leaf's template.
Every other part is a template of its own, tokens with a digit left variable.

A template recurs if it has ``MIN_DOCS`` witnesses. A document is one if at most ``COPIED`` of its parts (by
characters) stand elsewhere too; all other documents, copies and near copies above all, count as one witness
together. So boilerplate and passages that many documents share go, while copies of whole documents are left for
a near-duplicate operator and keep their text. Parts of recurring templates are dropped in every document; those
under ``MIN_TOKENS`` tokens always stay.

All statistics are over all different parts of all documents, and pre-aggregated before they are shuffled; rows
of a common part meet only as counts. Template identity is a 64-bit hash. The hashes that recur go to the documents
where these stand, as a broadcast set, if they are counted to be few; else they are joined to the documents.

Defined cases: a null text has no parts and stays null; empty texts and blank lines stay; repeated rows count
once for each row; rows with null ids take part; texts of any length are cut by one pass; an empty table gives no
rows; further columns stay as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelake.llm.common import MOST_BROADCAST, bounded_batches, few, fresh, text_of, written

LEADING = 3
MIN_TOKENS = 4
MIN_DOCS = 3
STEADY, FIXED, COPIED = 0.6, 0.7, 0.5
#: Stands for a variable field.
FIELD = "<*>"


#: A part: up to and with a sentence end or line end, or what is left of the last line.
PART = r"[^\n]*?(?:[.!?] |\n)|[^\n]+"


ENDS = (". ", "! ", "? ", "\n")
#: Set between parts to split there; a text that holds it is cut by the pattern.
_MARK = "\x01"


def _marked(text: Column, bare: bool) -> Column:
    for end in ENDS:
        text = F.replace(text, F.lit(end), F.lit((end[:-1] if bare else end) + _MARK))
    return F.array_remove(F.split(text, _MARK), "")


def parts_of(text: Column) -> Column:
    """The parts in order; joined they are the text again."""
    return F.when(F.contains(text, F.lit(_MARK)), F.regexp_extract_all(text, F.lit(PART), F.lit(0))).otherwise(_marked(text, False))


def bare_parts(text: Column) -> Column:
    """The different parts, each without the space or line end that it ends with."""
    plain = F.transform(F.regexp_extract_all(text, F.lit(PART), F.lit(0)), lambda x: F.regexp_replace(x, r"([.!?]) \z|\n\z", "$1"))
    return F.array_distinct(F.when(F.contains(text, F.lit(_MARK)), plain).otherwise(_marked(text, True)))


def masked(part: Column) -> Column:
    """The part between its outer spaces and line ends, with every token that holds a digit as a variable field."""
    part = F.trim(part, F.lit(" \n"))
    return F.when(part.rlike("[0-9]"), F.regexp_replace(part, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*", FIELD)).otherwise(part)


def part_table(documents: DataFrame) -> DataFrame:
    """A row for each different part of each document: doc_id, masked (the part with its fields), line_hash, leaf, chars (of the part).

    Tokens and leading ones are those of the masked part, as fields hold no space; so a part is looked through for digits once.
    """
    parts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(bare_parts(text_of())).alias("part")).withColumn("part", F.trim("part"))
    # with fewer tokens nothing is cut off
    rows = parts.filter(F.substring_index("part", " ", MIN_TOKENS - 1) != F.col("part"))
    rows = rows.select("doc_id", masked(F.col("part")).alias("masked"), F.char_length("part").alias("chars"))
    n = F.octet_length("masked") - F.octet_length(F.replace(F.col("masked"), F.lit(" "), F.lit(""))) + 1
    return rows.select("doc_id", "masked", F.xxhash64("masked").alias("line_hash"), F.xxhash64(n, F.substring_index("masked", " ", LEADING)).alias("leaf"), "chars")


def recurring(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """line_hash of all parts whose template recurs. lines: the written part table, of which most steps read the numbers alone."""
    counts = written(lines.groupBy("line_hash").agg(F.count(F.lit(1)).alias("docs"), F.min("leaf").alias("leaf")), "counts")
    # what grows with the parts is joined by shuffle at any size
    again = counts.filter("docs > 1").select("line_hash").hint("merge")
    shared = lines.join(again, "line_hash", "left_semi").groupBy("doc_id").agg(F.sum("chars").alias("shared"))
    totals = lines.groupBy(F.col("doc_id").alias("own_id")).agg(F.sum("chars").alias("chars"))
    shares = totals.join(shared, F.col("doc_id").eqNullSafe(F.col("own_id")), "left")
    own = shares.filter(F.coalesce("shared", F.lit(0)) <= COPIED * F.col("chars")).select("own_id", F.lit(1).alias("own"))
    # leaves in which several templates might be one
    mixed = counts.groupBy("leaf").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("kinds")).filter((F.col("docs") >= min_docs) & (F.col("kinds") > 1)).select("leaf")
    kinds = lines.join(few(mixed, "leaves"), "leaf", "left_semi")
    kinds = kinds.groupBy("leaf", "line_hash").agg(F.count(F.lit(1)).alias("docs"), F.first("masked").alias("masked"))
    template = few(leaf_templates(written(kinds, "kinds").select("leaf", "line_hash", "docs", F.split("masked", " ").alias("tokens"))), "templates")
    # witnesses per part, then per template: only parts that could reach the count are followed
    maybe = counts.filter(F.col("docs") >= min_docs).select("line_hash").unionByName(template.select("line_hash")).distinct().hint("merge")
    followed = lines.join(maybe, "line_hash", "left_semi").select("doc_id", "line_hash").join(own, F.col("doc_id").eqNullSafe(F.col("own_id")), "left").select("doc_id", "line_hash", F.coalesce("own", F.lit(0)).alias("own"))
    witnesses = F.sum("own") + F.max(1 - F.col("own"))
    by_line = followed.groupBy("line_hash").agg(witnesses.alias("n")).filter(F.col("n") >= min_docs).select("line_hash")
    named = followed.join(template, "line_hash").select("doc_id", "leaf", "own").distinct()
    by_leaf = named.groupBy("leaf").agg(witnesses.alias("n")).filter(F.col("n") >= min_docs).select("leaf")
    return by_line.unionByName(template.join(by_leaf, "leaf", "left_semi").select("line_hash")).distinct()


def leaf_templates(kinds: DataFrame) -> DataFrame:
    """leaf and line_hash of the parts that have all fixed tokens of their leaf's template.

    kinds: leaf, line_hash, docs, tokens; one row for each different part.
    """
    parts = kinds.select("leaf", "line_hash", "docs", F.size("tokens").alias("n"), F.posexplode("tokens").alias("pos", "token"))
    common = parts.groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("docs"))
    place = Window.partitionBy("leaf", "pos")
    fixed = common.withColumn("all", F.sum("docs").over(place)).filter(F.col("docs") >= STEADY * F.col("all")).select("leaf", "pos", F.col("token").alias("fixed"))
    sizes = fixed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n_fixed"))
    met = parts.join(fixed, ["leaf", "pos"]).filter(F.col("token") == F.col("fixed")).groupBy("leaf", "line_hash", "n").agg(F.count(F.lit(1)).alias("met"))
    return met.join(sizes, "leaf").filter((F.col("met") == F.col("n_fixed")) & (F.col("n_fixed") - LEADING >= FIXED * (F.col("n") - LEADING))).select("leaf", "line_hash")


_TOKEN = re.compile(r"(?<![^ ])[^ 0-9]*[0-9][^ ]*")
_DIGIT = re.compile(r"[0-9]")


def _cut(text: str) -> list[str]:
    """parts_of in a task."""
    if _MARK in text:
        return re.findall(PART, text)
    for end in ENDS:
        text = text.replace(end, end + _MARK)
    return [x for x in text.split(_MARK) if x]


def _goes(part: str, gone: frozenset[int]) -> bool:
    """Whether a part's template is among the recurring ones (which hold no short ones)."""
    part = part.strip(" \n")
    if part.count(" ") < MIN_TOKENS - 1:
        return False
    if _DIGIT.search(part):
        part = _TOKEN.sub(FIELD, part)
    return xxhash.xxh64_intdigest(part.encode("utf-8", "replace"), 42) in gone


def _in_place(documents: DataFrame, gone: frozenset[int], counts: list[str]) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(gone)
    bounded_batches(documents.sparkSession)
    at = documents.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, drops = [], [], []
            for text in batch.column(at):
                text = text.as_py()
                parts = _cut(text or "")
                kept = [x for x in parts if not _goes(x, shared.value)]
                texts.append(text if len(kept) == len(parts) else "".join(kept))
                sizes.append(len(parts))
                drops.append(len(parts) - len(kept))
            names = [*batch.schema.names, *counts]
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int32()), pa.array(drops, pa.int32())], names=names)

    schema = T.StructType([*documents.schema.fields, *(T.StructField(c, T.IntegerType()) for c in counts)])
    return documents.mapInArrow(task, schema)


def _joined(documents: DataFrame, lines: DataFrame, gone: DataFrame, counts: list[str]) -> DataFrame:
    drop_id, drop, whole, rest = fresh(documents, "_drop_id", "_drop", "_all", "_kept")
    drops = lines.join(gone, "line_hash", "left_semi").groupBy(F.col("doc_id").alias(drop_id)).agg(F.collect_set("line_hash").alias(drop))
    rows = documents.join(drops, F.col("doc_id").cast("long").eqNullSafe(F.col(drop_id)), "left").withColumn(whole, parts_of(text_of()))
    kept = F.when(F.col(drop).isNull(), F.col(whole)).otherwise(F.filter(whole, lambda x: ~F.array_contains(F.col(drop), F.xxhash64(masked(x)))))
    rows = rows.withColumn(rest, kept).withColumn(counts[0], F.size(whole)).withColumn(counts[1], F.size(whole) - F.size(rest))
    text = F.when(F.col(counts[1]) == 0, F.col("text")).otherwise(F.array_join(rest, ""))
    return rows.withColumn("text", text).select(*documents.columns, *counts)


def _cleaned(documents: DataFrame, min_docs: int, most: int = MOST_BROADCAST) -> tuple[DataFrame, str, str]:
    """The documents without recurring parts in text, and the names of two columns more: parts before, dropped ones."""
    counts = fresh(documents, "_parts", "_dropped")
    lines = written(part_table(documents), "lines")
    gone = written(recurring(lines, min_docs), "recurring")
    if gone.count() <= most:
        return _in_place(documents, frozenset(r[0] % (1 << 64) for r in gone.toLocalIterator()), counts), *counts
    return _joined(documents, lines, gone, counts), *counts


def report(documents: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per document: n_lines (its parts), n_dropped, and size and digest of what is left."""
    rows, parts, dropped = _cleaned(documents.select("doc_id", "text"), min_docs)
    return rows.select("doc_id", F.col(parts).cast("long").alias("n_lines"), F.col(dropped).alias("n_dropped"), F.char_length(text_of()).cast("long").alias("kept_chars"), F.sha2(text_of().cast("binary"), 256).alias("kept_sha256"))


def drop_recurring(documents: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with recurring parts taken out of text (n_chars, where there is one, follows)."""
    rows, _, dropped = _cleaned(documents, min_docs)
    if "n_chars" in documents.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(dropped) == 0, F.col("n_chars")).otherwise(F.char_length("text").cast(documents.schema["n_chars"].dataType)))
    return rows.select(*documents.columns)
