"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A shape names five of up to eight neighbouring words; the others may differ.  Wherever
the words lie that an item of eight words or more may lose (a fifth of a window of up
to 13), one of the three shapes misses them all.  A shorter item is cut into one part
more than it may lose words, and each part is a seed.  Every seed begins with a pair of
neighbouring words (or is one word), so places of documents whose pair no item has are
left out first.  Seeds of the benchmark meet seeds of the documents in one equi-join,
and each hit fixes how the item lies over the document.  There the words are compared
position by position: the overlap counts if in some `window` neighbouring words of the
item (the whole item if it is shorter) at least `share` are the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapane.llm.common import small, staged
from terrapane.llm.quality_rules import words_of

#: Shapes of weight five that, together, hit every placement of the changes allowed.
SHAPES = ((0, 1, 2, 4, 5), (0, 1, 3, 6, 7), (0, 1, 2, 3, 4))
#: Items of fewer words are cut into parts instead; of fewer than SHORTEST, they are common phrases and not searched.
SPAN, SHORTEST = 8, 3
#: Bytes of the benchmark's words, and rows of its seeds, up to which they are broadcast; beyond that the joins shuffle.
BROADCAST_SEEDS, BROADCAST_BYTES = 300_000, 64 << 20


def plain_words(text: str) -> Column:
    """Lower-cased words without ASCII punctuation; none for null."""
    return words_of(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[!-/:-@\[-`{-~]+", ""))


def parts(n: int, share: float) -> list[tuple[int, ...]]:
    """The places of the parts of an item of n words, fewer than SPAN: one more than it may lose words, so that one is whole."""
    lost = max(k for k in range(n) if n - k >= share * n - 1e-9)
    cuts = [n * k // (lost + 1) for k in range(lost + 2)]
    return [tuple(range(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@dataclass(frozen=True)
class Seed:
    """Words at `offsets` from a place.  In items of `only` words (any of SPAN or more if that is None) it stands at `at` alone, else anywhere."""

    tag: int
    offsets: tuple[int, ...]
    only: int | None = None
    at: int | None = None

    def value(self, words: str, place: str) -> str:
        """SQL of the seed's hash; null where it goes beyond the last word."""
        picked = ", ".join(f"{words}[{place} + {o}]" for o in self.offsets)
        return f"CASE WHEN {place} + {self.offsets[-1]} < size({words}) THEN xxhash64({self.tag}, {picked}) END"


LONG = tuple(Seed(i, shape) for i, shape in enumerate(SHAPES))


def _seeds_of(lengths: list[int], share: float) -> list[Seed]:
    """The seeds for items of these numbers of words."""
    out = list(LONG) if any(n >= SPAN for n in lengths) else []
    for n in sorted({n for n in lengths if SHORTEST <= n < SPAN}):
        out += [Seed(16 * n + i, tuple(x - p[0] for x in p), n, p[0]) for i, p in enumerate(parts(n, share))]
    return out


def _item_seeds(items: DataFrame, seeds: list[Seed]) -> DataFrame:
    """seed, item_key, at and pair (of the two words where the seed begins, or the one) of all items."""
    found = []
    for s in seeds:
        if s.only is None:
            at = items.filter(F.size("item") >= SPAN).withColumn("at", F.explode(F.expr(f"sequence(0, size(item) - {s.offsets[-1] + 1})")))
        else:
            at = items.filter(F.size("item") == s.only).withColumn("at", F.lit(s.at))
        pair = F.expr("xxhash64(item[at], item[at + 1])" if len(s.offsets) > 1 else "xxhash64(item[at])")
        found.append(at.select(F.expr(s.value("item", "at")).alias("seed"), "item_key", "at", pair.alias("pair")))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def _probes(d: DataFrame, seeds: list[Seed], pairs: DataFrame | None) -> DataFrame:
    """Every place p of the documents with each seed there; with `pairs`, places with such a pair only."""
    at = d.withColumn("p", F.explode(F.expr("sequence(0, size(words) - 1)")))
    if pairs is not None:
        hit = at.withColumn("pair", F.expr("xxhash64(words[p], get(words, p + 1))")).join(F.broadcast(pairs), "pair", "left_semi")
        if any(len(s.offsets) == 1 for s in seeds):
            hit = hit.unionByName(at.withColumn("pair", F.expr("xxhash64(words[p])")).join(F.broadcast(pairs), "pair", "left_semi"))
        at = hit.drop("pair")
    return at.withColumn("seed", F.explode(F.array(*[F.expr(s.value("words", "p")) for s in seeds]))).filter("seed IS NOT NULL")


def _cut(hits: DataFrame) -> DataFrame:
    """Hits with the words under the item only: a long text with many hits isn't copied whole for each."""
    under = F.expr("slice(words, greatest(lie, 0) + 1, size(item) + least(lie, 0))")
    return hits.select("doc_id", "text_key", "item_key", "item", "lie", under.alias("under"))


def overlap(doc_words: str, item_words: str, lies: str, window: int) -> Column:
    """The most equal words in `window` neighbouring ones, where the item's word t lies over the document's word t + lies."""
    n = f"size({item_words})"
    w = f"least({window}, {n})"
    same = f"transform(sequence(0, {n} - 1), t -> CASE WHEN t + {lies} >= 0 AND t + {lies} < size({doc_words}) AND {item_words}[t] = {doc_words}[t + {lies}] THEN 1 ELSE 0 END)"
    sums = f"aggregate({same}, array(0), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    best = f"array_max(transform(sequence(0, {n} - {w}), t -> s[t + {w}] - s[t]))"
    inside = f"{lies} >= 0 AND slice({doc_words}, greatest({lies}, 0) + 1, {n}) = {item_words}"
    return F.expr(f"CASE WHEN {inside} THEN {w} ELSE transform(array({sums}), s -> {best})[0] END")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    share: float = 0.8,
    broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """doc_id, text_key, items (item ids, sorted) and matched (the largest share of a window) of each contaminated text.

    text_key is xxhash64 of the text; (doc_id, text_key) names rows, so that repeated ids with other texts
    keep their own verdicts.  Null and empty texts, and items of fewer than SHORTEST words, are never part of an
    overlap.  An empty benchmark contaminates nothing.  A null item id counts as an item.  Items with equal words
    are searched once.  The seeds are complete for a share of 0.8 or more of windows of up to 13 words.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), plain_words(text).alias("words")).filter("size(words) > 0")
    named = benchmark.select(F.col(item_id).alias("item_id"), plain_words(item_text).alias("item")).distinct()
    named = staged(named.filter(F.size("item") >= SHORTEST).withColumn("item_key", F.xxhash64("item")), "items")
    items, ids = named.select("item_key", "item").distinct(), named.select("item_key", "item_id")
    # a row for each number of words below SPAN, and one for all others
    sizes = [r["n"] for r in named.select(F.least(F.size("item"), F.lit(SPAN)).alias("n")).distinct().collect()]
    seeds = _seeds_of(sizes, share)
    if not seeds:
        kind = named.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"doc_id {docs.schema[doc_id].dataType.simpleString()}, text_key long, items array<{kind}>, matched double")
    bench = staged(_item_seeds(items, seeds), "seeds")
    size = items.agg(F.sum(F.length(F.concat_ws(" ", "item")))).first()[0]
    small = bench.count() <= broadcast_seeds and size <= BROADCAST_BYTES
    probes = _probes(d, seeds, bench.select("pair").distinct() if small else None)
    bench = bench.select("seed", "item_key", "at").distinct()
    if small:
        hits = probes.join(F.broadcast(bench), "seed").withColumn("lie", F.col("p") - F.col("at")).join(F.broadcast(items), "item_key")
    else:
        # only places travel; the words come back for distinct lies of an item over a text
        lies = probes.select("seed", "doc_id", "text_key", "p").join(bench, "seed")
        lies = lies.select("doc_id", "text_key", "item_key", (F.col("p") - F.col("at")).alias("lie")).distinct().join(items, "item_key")
        texts = d.dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias("i"), F.col("text_key").alias("k"), "words")
        hits = lies.join(texts, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")))
    hits = _cut(hits)
    hits = hits.withColumn("same", overlap("under", "item", "least(lie, 0)", window))
    # By item first: its many hits become one row in the task that found them.  The threshold comes after: before, the optimiser
    # would move it into the join, whose rows would then be built for every seed and not just for hits.
    part = F.col("same") / F.least(F.lit(window), F.size("item"))
    by_item = hits.groupBy("doc_id", "text_key", "item_key").agg(F.max(part).alias("matched")).filter(F.col("matched") >= share)
    by_item = by_item.join(F.broadcast(ids) if small else ids, "item_key")
    return by_item.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("matched").alias("matched"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with contaminated, items and matched: false, no items and 0 for a clean text.  All rows and columns stay."""
    found = staged(contamination(docs, benchmark, doc_id, text, **options), "found")
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("items").alias("_items"), F.col("matched").alias("_matched"))
    found = small(found)
    keyed = docs.drop(*[c for c in ("contaminated", "items", "matched") if c not in (doc_id, text)]).withColumn("_text_key", F.xxhash64(F.col(text)))
    out = keyed.join(found, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left")
    return out.withColumns(
        {
            "contaminated": F.col("_key").isNotNull(),
            "items": F.coalesce(F.col("_items"), F.array().cast(found.schema["_items"].dataType)),
            "matched": F.coalesce(F.col("_matched"), F.lit(0.0)),
        }
    ).drop("_id", "_key", "_items", "_matched", "_text_key")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` that decontaminated finds clean, as they are.  Only keys of the others travel, and no text while they are few."""
    found = staged(contamination(docs, benchmark, doc_id, text, **options).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "found")
    same = docs[doc_id].eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text]) == F.col("_key"))
    return docs.join(small(found), same, "left_anti")
