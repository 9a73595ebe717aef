"""Mixing sources to target weights by nested hash thresholds, in DataFrame functions only.

Every document has a fixed 36-bit hash.  A source takes each of its documents the
same whole number of times, and once more those below a threshold.  The threshold
is found from histograms: tokens by source and the hash's first 12 bits give the
bucket where the budget runs out; only that bucket is counted again by the next 12
bits, and then by the last 12.  Nothing is sorted and no group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapane.llm.common import SPACES, only_kept, staged

WEIGHTS = (5, 2, 1)
CAP = 3
BITS, LEVELS = 12, 3
#: Sources up to which their thresholds, some 60 bytes each, are broadcast.  Beyond that the rows are shuffled by source, and Spark splits large ones.
BROADCAST_SOURCES = 300_000


def n_words(text: str) -> Column:
    """Words of a text: white-space runs between words, plus one; 0 for null and for a text without a word."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(F.size(F.split(t, SPACES))).cast("long")


def hash36(doc_id: str, text: str) -> Column:
    """36 bits of the id's md5, the same in any SQL engine; without an id, of the text's."""
    named = F.coalesce(F.col(doc_id).cast("string"), F.col(text), F.lit(""))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 9), 16, 10).cast("long")


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size and the target of each source, from a row for each source.

    The targets share all words by weight; one stops at cap times its source's size
    and the rest is shared again by weight.  That is min(cap * size, level * weight)
    at one level for all, found by ordering sources by the level at which they stop.
    One row a source is all that meets here.
    """
    by_code_point = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = by_source.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_code_point) - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("_stop", F.lit(float(cap)) * F.col("source_size") / F.col("_w"))
    before = Window.orderBy("_stop", F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("_stop", F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = w.withColumn("_all", F.sum("source_size").over(everything).cast("double"))
    left = F.col("_all") - F.coalesce(F.sum(F.lit(float(cap)) * F.col("source_size")).over(before), F.lit(0.0))
    w = w.withColumn("_level", left / F.sum("_w").over(after))
    # levels fall from the first source that does not stop below its own on: that one holds for all
    w = w.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_stop"), F.col("_level"))).over(everything))
    t = F.least(F.lit(float(cap)) * F.col("source_size"), F.coalesce(F.col("_level"), F.lit(float("inf"))) * F.col("_w"))
    return w.select("source", "source_size", t.alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row of `docs`.

    A null text has size 0; null is a source of its own, last in order; equal ids
    have equal hashes and are taken together, and so are equal texts without an id.  A source's taken words differ from its
    target by half the words of one hash value at most.  Empty tables give no rows.
    """
    sized = _sized(docs, doc_id, source, text)
    with only_kept() as keep:
        made, n = thresholds(sized, weights, cap)
        keep(made)
    out = _copies(sized, made, n, cap).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of `docs` that the mix takes, each as often as it takes them.

    The texts aren't shuffled while there are at most BROADCAST_SOURCES sources.  Nulls and ties as in mix.
    """
    with only_kept() as keep:
        made, n = thresholds(_sized(docs, doc_id, source, text), weights, cap)
        keep(made)
    named = docs.withColumns({"_h": hash36(doc_id, text), "_src": F.col(source)})
    out = _copies(named, made, n, cap, "_h", "_src", "_copies").filter("_copies > 0")
    return out.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(*docs.columns)


def _sized(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    return staged(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"), hash36(doc_id, text).alias("h")), "mix")


def _copies(rows: DataFrame, made: DataFrame, n: int, cap: int, h: str = "h", source: str = "source", name: str = "copies") -> DataFrame:
    """`rows` with their source's threshold and the number of copies.  The thresholds have a row for each source, and are broadcast while there are few."""
    made = F.broadcast(made) if n <= BROADCAST_SOURCES else made
    more = F.when(F.col(h) < F.col("_below"), 1).otherwise(0)
    return rows.join(made, F.col(source).eqNullSafe(F.col("_source"))).withColumn(name, F.least(F.col("_whole") + more, F.lit(cap)).cast("long"))


def thresholds(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> tuple[DataFrame, int]:
    """For each source: whole copies of each document, and the hash below which there is one more; and how many sources."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(totals, weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goals.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    state = staged(state.withColumn("prefix", F.lit(0).cast("long")).withColumnRenamed("source", "_source"), "mix-goals")
    n = state.count()
    same = F.col("source").eqNullSafe(F.col("_source"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        small = F.broadcast(state) if n <= BROADCAST_SOURCES else state
        inside = sized.join(small, same & (F.shiftright("h", shift + BITS) == F.col("prefix")))
        hist = inside.groupBy("_source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        # at most 2^BITS rows a source: which bucket takes the running sum beyond what is left
        run = Window.partitionBy("_source").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("words").over(run)).withColumnRenamed("_source", "_s")
        s = state.join(hist, F.col("_source").eqNullSafe(F.col("_s")), "left")
        fits = F.coalesce(F.col("upto") <= F.col("left"), F.lit(False))
        keys = ["_source", "source_size", "target", "whole", "left", "prefix"]
        s = s.groupBy(*keys).agg(
            F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("inside"),
            F.min(F.when(~fits, F.struct("bucket", "words"))).alias("edge"),
        )
        more = F.col("left") - F.col("inside")
        if level < LEVELS - 1:
            # without an edge all fit: a prefix that no hash has, and everything below it is taken
            state = s.select("_source", "source_size", "target", "whole", more.alias("left"), F.coalesce(F.col("edge.bucket"), (F.col("prefix") + 1) * F.lit(1 << BITS)).alias("prefix"))
            state = staged(state, "mix-goals")
        else:
            nearer = F.col("edge").isNotNull() & ((F.col("edge.words") - more) <= more)
            below = F.when(F.col("edge").isNull(), (F.col("prefix") + 1) * F.lit(1 << BITS)).otherwise(F.col("edge.bucket") + nearer.cast("long"))
            state = s.select("_source", "source_size", "target", "whole", below.alias("below"))
    made = state.withColumnsRenamed({"whole": "_whole", "below": "_below"})
    return staged(made, "mix-goals"), n


__all__ = ["hash36", "mix", "mixed", "n_words", "targets", "thresholds"]
