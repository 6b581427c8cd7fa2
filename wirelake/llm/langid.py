"""Language identification by compression: the language whose dictionary encodes a text in the fewest bytes.

A language's dictionary is raw content for zstandard: pieces of its labelled texts. A text is encoded with each
language's dictionary, in blocks of ``BLOCK`` bytes that know the dictionary but not each other, so the dictionary counts
as much at the end of a long text as at its beginning. Only words count: letters are lower-cased, whatever lies
between them is one space. The smallest sum of sizes wins, ties going to the language with more labelled rows, then by name.

The margin is the part by which the best sum lies under the second best; where it is narrow, the text is rejected. The
score is the best language's share where each byte more makes a language ``PER_BYTE`` times as likely.

The dictionaries hold at most ``PIECES`` pieces of ``PIECE`` characters for each language, of different texts in the order of
their hash, each from a place in its text that the hash chooses; rows are counted over all documents. The sizes come
from whole texts.

Defined cases: a null text, and one without a letter, is ``und`` with score and margin 0, and so is every text if no row
has a language; equal texts get equal results; a learned language counts also if it has one piece only; rows of null language are
never learnt from; a text of any length takes time in proportion to it; repeated rows each give a row; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake.llm.common import batch_of, bounded_batches, text_of, written

UNKNOWN = "und"
#: Pieces of each language's dictionary at most, and characters of each.
PIECES, PIECE = 56, 2000
BLOCK, LEVEL = 1024, 9
#: The margin from which a result is accepted.
MIN_MARGIN = 0.01
PER_BYTE = 0.6

_BETWEEN = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 4 == 2, F.lit(False))


def words_of(text: str) -> bytes:
    """The text's words between single spaces; empty if it has no letter."""
    words = _BETWEEN.sub(" ", text).strip()
    return words.lower().encode("utf-8", "replace") if any(c.isalpha() for c in words) else b""


@dataclass(frozen=True)
class Model:
    """Dictionaries by language, those of more labelled rows first."""

    dictionaries: dict[str, bytes] = field(default_factory=dict)

    def coders(self) -> dict[str, zstandard.ZstdCompressor]:
        out = {}
        for lang, content in self.dictionaries.items():
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            out[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)
        return out


def sizes(words: bytes, coders: dict[str, zstandard.ZstdCompressor]) -> dict[str, int]:
    """Bytes that each language's dictionary takes for the words, block by block."""
    out = dict.fromkeys(coders, 0)
    for i in range(0, len(words), BLOCK):
        block = words[i : i + BLOCK]
        for lang, coder in coders.items():
            out[lang] += len(coder.compress(block))
    return out


def chosen(found: dict[str, int]) -> tuple[str, float, float]:
    """(language, score, margin) of the sizes; of equal ones the first counts."""
    if not found:
        return UNKNOWN, 0.0, 0.0
    best = min(found, key=found.__getitem__)
    least = found[best]
    second = min((n for lang, n in found.items() if lang != best), default=None)
    score = 1 / sum(PER_BYTE ** min(n - least, 500) for n in found.values())
    return best, score, 1.0 if second is None else 1 - least / second


def fit(documents: DataFrame) -> Model:
    """The dictionaries, from the rows that are not held out and have a language."""
    labelled = documents.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), text_of().alias("text")).filter(F.col("text").rlike(r"\p{L}"))
    labelled = labelled.select("lang", "text", F.xxhash64("text").alias("mark"))
    # one row for each different text, so that many copies are one piece; then the first of each language
    marks = written(labelled.groupBy("lang", "mark").agg(F.count(F.lit(1)).alias("n")), "marks")
    known = {r["lang"]: r for r in marks.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n")).collect()}  # a row for each language
    # hashes are spread evenly, so that the first ones of a language lie below a bound known from their number
    low = F.lit(False)
    for lang, r in known.items():
        low = F.when(F.col("lang") == lang, F.col("mark") <= min((1 << 63) - 1, (1 << 64) * 4 * PIECES // r["texts"] - (1 << 63))).otherwise(low)
    ranked = marks.filter(low).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("mark"))).filter(F.col("rank") <= PIECES)
    place = F.pmod(F.col("mark"), F.greatest(F.char_length("text") - PIECE, F.lit(0)) + 1).cast("int") + 1
    piece = F.substring(F.col("text"), place, F.lit(PIECE))
    sample = labelled.join(F.broadcast(ranked.select("lang", "mark")), ["lang", "mark"], "left_semi")  # PIECES rows a language
    sample = sample.groupBy("lang", "mark").agg(F.min(piece).alias("piece"))
    pieces: dict[str, list[tuple[int, bytes]]] = {}
    for lang, mark, text in sample.collect():
        if words := words_of(text):
            pieces.setdefault(lang, []).append((mark, words))
    order = sorted(pieces, key=lambda lang: (-known[lang]["n"], lang))
    return Model({lang: b" ".join(words for _, words in sorted(pieces[lang])) for lang in order})


FOUND = "doc_id long, held_out boolean, lang_pred string, score double, margin double, accepted boolean"
_FOUND = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("accepted", pa.bool_())])


def identify(documents: DataFrame, model: Model, min_margin: float = MIN_MARGIN) -> DataFrame:
    """Per document the best language, its score and margin, and whether the margin is wide enough to accept it."""
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = shared.value.coders()
        for batch in batches:
            out: dict[str, list] = {"doc_id": batch.column(0).to_pylist(), "held_out": batch.column(1).to_pylist()} | {n: [] for n in _FOUND.names[2:]}
            for text in batch.column(2):
                words = words_of(text.as_py())
                lang, score, margin = chosen(sizes(words, coders)) if words else (UNKNOWN, 0.0, 0.0)
                for name, value in zip(_FOUND.names[2:], (lang, score, margin, lang != UNKNOWN and margin >= min_margin), strict=True):
                    out[name].append(value)
            yield batch_of(_FOUND, out)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_of().alias("text"))
    return rows.mapInArrow(task, FOUND)


def keep_language(documents: DataFrame, model: Model, langs: tuple[str, ...], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The identified rows (doc_id and result) whose language is one of these by a wide enough margin."""
    return identify(documents, model, min_margin).filter(F.col("accepted") & F.col("lang_pred").isin(*langs))
