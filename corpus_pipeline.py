"""The corpus pipeline: toxic documents go, recurring lines go, one of each group of near copies stays, the
sources are mixed to their weights, and the rest is tokenised and packed.

Each stage gets the documents that its predecessor kept, written and read again, and returns the columns of
documents; the last returns the packed pieces. SQL cannot express the stages (a trained classifier, the
tokenizer), so ORACLE_SQL is None; tests hold each stage against a plain version.

Defined cases, by stage as the operators' own docstrings say: a null or empty text is scored as one without words, has no lines, is linked
with nothing and has no tokens, and is packed as the closing id alone; null ids take part; repeated rows go through
toxicity and line dedup as they are and leave one of each group behind; an empty table gives no pieces; further
columns of documents stay up to packing. Where a leaf is seen twice in mixing, its documents are packed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wirelake.llm import jaccard, linetemplates, mixing, packing, toxicity
from wirelake.llm.common import read_table, written
from wirelake.llm.queries import VOCABULARY

#: The whole supply is the budget: leaves above their weight are cut, those below it are seen up to twice.
MIXTURE = mixing.Mixture(share=1, of=1, epochs=2, seed="pipeline")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linetemplates.drop_recurring(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, MIXTURE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_recurring_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
