"""Mixing sources to target weights by hierarchical budgeting.

Leaves of a tree domain - language - source have a supply of tokens. The token budget flows down the tree:
at each node it is shared among the children by weight, no child getting more than its whole subtree can
give; what a child can't take goes to its siblings, and only what a whole family can't take goes to its
parent's siblings. So shortages are made up by the nearest relatives first. Shares are whole tokens, in
integer arithmetic; a child that can take all of its share is exact to one token.

A leaf gives whole epochs of its documents, then a token prefix of one more: its documents in the order of a
seeded hash of (epoch, doc_id), up to the one in which the budget ends. Running totals go by buckets of
the hash: totals of buckets first, then of the rows within each, so a leaf with a third of all rows is
many tasks' work.

Defined cases: a null or empty text has no tokens and is taken in every epoch its leaf gives in full, and in
the last one if its place lies before the budget's end; nulls in lang or source are a leaf of their own;
rows of one doc_id and leaf stand and fall together, null ids among them; ties of the hash go by doc_id;
an empty table gives no rows; further columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake.llm.common import column_or_null, fresh, text_of

LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The sources' domains: by the number in a source's name; a source without a number is a reference."""
    number = F.regexp_extract(source, "[0-9]+$", 0).try_cast("int")
    return F.when(number < 8, "web").when(number < 13, "forum").when(number < 17, "news").otherwise("reference")


@dataclass(frozen=True)
class Mixture:
    """Weights by level: of a domain, of a language in any domain, of a source; other names weigh ``other``."""

    domains: dict = field(default_factory=lambda: {"web": 40, "forum": 30, "news": 20, "reference": 10})
    langs: dict = field(default_factory=lambda: {"en": 40, "de": 25, "fr": 25, "es": 10})
    sources: dict = field(default_factory=dict)
    other: int = 10
    #: The budget as parts of the whole supply: share / of.
    share: int = 1
    of: int = 2
    #: Times that a leaf's documents may be taken.
    epochs: int = 2
    seed: str = "mix-1"
    #: The domain of a source, as a column expression.
    domain: Callable[[Column], Column] = domain_of


DEFAULT = Mixture()


def tokens(text: Column) -> Column:
    """Words between white space, as a count of tokens."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _weight(name: Column, weights: dict, other: int) -> Column:
    out = F.lit(other)
    for key in sorted(weights, reverse=True):
        out = F.when(name == key, F.lit(weights[key])).otherwise(out)
    return out.cast("long")


def _shared(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds budget: the parent's (column total) shared among its children by weight within their capacity.

    Children in the order of capacity per weight: those that can't take their share of what is left come
    first and get all they can take; the rest share the remainder.
    """
    family = Window.partitionBy(*parent)
    order = family.orderBy(F.col("capacity") / F.col("weight"), F.col(name).asc_nulls_first())
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = children.withColumn("short", F.col("capacity") * weights <= (F.col("total") - before) * F.col("weight"))
    # once one child can take its share, so can all after it
    rows = rows.withColumn("short", F.min(F.col("short").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1)
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("short"), F.col("capacity"))).over(family), F.lit(0))
    heavy = F.sum(F.when(~F.col("short"), F.col("weight"))).over(family)
    rows = rows.withColumn("rest", rest).withColumn("heavy", heavy)
    share = F.expr("least(capacity, (rest * weight) div heavy)")
    return rows.withColumn("budget", F.when(F.col("short"), F.col("capacity")).otherwise(share)).drop("short", "rest", "heavy")


def budgets(leaves: DataFrame, mixture: Mixture = DEFAULT) -> DataFrame:
    """domain, lang, source, supply, budget of every leaf. leaves: one row for each, with its supply in tokens."""
    rows = leaves.select(*LEVELS, "supply", (F.col("supply") * mixture.epochs).alias("capacity"))
    domains = rows.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("supply").alias("supply"))
    whole = Window.partitionBy(F.lit(1))
    domains = domains.withColumn("supply", F.sum("supply").over(whole))
    domains = domains.withColumn("total", F.expr(f"least((supply * {mixture.share}) div {mixture.of}, supply * {mixture.epochs})")).drop("supply")
    domains = _shared(domains.withColumn("weight", _weight(F.col("domain"), mixture.domains, mixture.other)).withColumn("all", F.lit(1)), ["all"], "domain")
    langs = rows.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).join(domains.select("domain", F.col("budget").alias("total")), "domain")
    langs = _shared(langs.withColumn("weight", _weight(F.col("lang"), mixture.langs, mixture.other)), ["domain"], "lang")
    held = langs.select(F.col("domain").alias("_domain"), F.col("lang").alias("_lang"), F.col("budget").alias("total"))
    sources = rows.join(held, (rows["domain"] == held["_domain"]) & rows["lang"].eqNullSafe(held["_lang"])).drop("_domain", "_lang")
    sources = _shared(sources.withColumn("weight", _weight(F.col("source"), mixture.sources, mixture.other)), ["domain", "lang"], "source")
    return sources.select(*LEVELS, "supply", "budget")


def copies(documents: DataFrame, mixture: Mixture = DEFAULT) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and n_copies of every document (rows of one id and leaf as one)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), column_or_null(documents, "lang", "string").alias("lang"), column_or_null(documents, "source", "string").alias("source"), tokens(text_of()).alias("n"))
    rows = rows.groupBy("doc_id", "lang", "source").agg(F.sum("n").alias("n_tokens")).withColumn("domain", mixture.domain(F.col("source")))
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"), F.count(F.lit(1)).alias("rows"))
    given = budgets(leaves, mixture)
    most = leaves.agg(F.max("rows")).first()[0] or 0
    digits = 0
    while most > 256**digits:  # about as many buckets in the largest leaf as rows in each of them
        digits += 1
    given = given.select(*(F.col(c).alias(f"_{c}") for c in LEVELS), "supply", "budget")
    same = [rows[c].eqNullSafe(given[f"_{c}"]) for c in LEVELS]
    rows = rows.join(given, same[0] & same[1] & same[2]).drop(*(f"_{c}" for c in LEVELS))
    full = F.when(F.col("supply") > 0, F.expr("budget div greatest(supply, 1)")).otherwise(F.lit(1))
    rows = rows.withColumn("full", full.cast("int")).withColumn("rest", F.col("budget") - F.col("full") * F.col("supply"))
    rows = rows.withColumn("place", F.md5(F.concat(F.lit(mixture.seed), F.lit(":"), F.col("full").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    rows = rows.withColumn("bucket", F.substring("place", 1, digits) if digits else F.lit(""))
    leaf = Window.partitionBy(*LEVELS)
    totals = rows.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("own"))
    totals = totals.withColumn("ahead", F.sum("own").over(leaf.orderBy("bucket")) - F.col("own")).select(*(F.col(c).alias(f"_{c}") for c in (*LEVELS, "bucket")), "ahead")
    same = [rows[c].eqNullSafe(totals[f"_{c}"]) for c in (*LEVELS, "bucket")]
    rows = rows.join(totals, same[0] & same[1] & same[2] & same[3]).drop(*(f"_{c}" for c in (*LEVELS, "bucket")))
    within = Window.partitionBy(*LEVELS, "bucket").orderBy("place", F.col("doc_id").asc_nulls_first())
    start = F.col("ahead") + F.sum("n_tokens").over(within) - F.col("n_tokens")
    return rows.withColumn("start", start).select("doc_id", *LEVELS, "n_tokens", (F.col("full") + ((F.col("start") < F.col("rest")) & (F.col("full") < mixture.epochs)).cast("int")).alias("n_copies"))


def mix(documents: DataFrame, mixture: Mixture = DEFAULT) -> DataFrame:
    """The documents' rows, each as often as the mixture takes it, in the documents' own columns."""
    key, lang, source, times = fresh(documents, "_mix_id", "_mix_lang", "_mix_source", "_mix_copies")
    taken = copies(documents, mixture).filter("n_copies > 0").select(F.col("doc_id").alias(key), F.col("lang").alias(lang), F.col("source").alias(source), F.col("n_copies").alias(times))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & column_or_null(documents, "lang", "string").eqNullSafe(F.col(lang)) & column_or_null(documents, "source", "string").eqNullSafe(F.col(source))
    return documents.join(taken, same).withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*documents.columns)
