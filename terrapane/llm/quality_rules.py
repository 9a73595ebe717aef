"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a Boolean expression that rejects a text.  On a bounded sample, drawn by
a hash, the cascade measures what a rule costs and which rows it rejects.  It takes
the rule with the most rejections per cost, then the best one for the rows that are
left, and so on, and evaluates the rules in that order inside one CASE expression,
which stops at the first that holds.  The order changes the time, never the verdict.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapane.llm.common import SPACE_CHARS, SPACES

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A name and the SQL condition, over the text column `t` and the base columns, under which a text is rejected."""

    name: str
    rejects: str


#: The production rules.  `t` is the text, never null; n_words and the other base columns can be used.
RULES = (
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("shouting", "10 * (length(t) - length(replace(t, '!', ''))) > 3 * n_words"),
    Rule("repeated_lines", "n_dup_lines > 3 and 10 * n_dup_lines > 3 * size(split(t, '\\n'))"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("upper_case", "2 * length(regexp_replace(t, '[^\\\\p{Lu}]+', '')) > word_chars"),
    Rule("digits", "5 * length(regexp_replace(t, '[^0-9]+', '')) > 2 * word_chars"),
)


def words_of(text: str | Column) -> Column:
    """The words of a text as an array; none for a null text."""
    return F.array_remove(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACES), "")


def repeated_words(words: str) -> Column:
    """How many words of array column `words` lie in 3-word windows that occur twice or more.

    In most texts the windows' 64-bit hashes are all distinct, which proves that the
    windows are; only other texts sort the windows themselves, so that equal ones meet.
    """
    starts = f"sequence(0, size({words}) - 3)"
    hashes = f"transform({starts}, i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2]))"
    windows = f"sort_array(transform({starts}, i -> struct(concat_ws(' ', {words}[i], {words}[i + 1], {words}[i + 2]) as g, i as i)))"
    twice = "filter(sequence(0, size(s) - 1), k -> (k > 0 and s[k - 1].g = s[k].g) or (k < size(s) - 1 and s[k + 1].g = s[k].g))"
    covered = f"size(array_distinct(flatten(transform({twice}, k -> array(s[k].i, s[k].i + 1, s[k].i + 2)))))"
    return F.expr(
        f"CAST(CASE WHEN size({words}) < 4 THEN 0 WHEN size(array_distinct({hashes})) = size({words}) - 2 THEN 0"
        f" ELSE transform(array({windows}), s -> {covered})[0] END AS BIGINT)"
    )


def base_columns(docs: DataFrame, text: str = "text", repeats: bool = True) -> DataFrame:
    """`docs` with t (the text, null as empty), n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    A null or empty text has no words and zeros everywhere.  Equal rows get equal values.  Without `repeats` the words
    stay as _words instead of n_repeat_words, which costs as much as all others.
    """
    lines = f"filter(split(t, '\n'), x -> length(trim(BOTH '{SPACE_CHARS}' FROM x)) > 0)"
    out = docs.withColumn("t", F.coalesce(F.col(text), F.lit(""))).withColumn("_words", words_of("t")).withColumn("_lines", F.expr(lines))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace("t", f"[^{SYMBOLS}]+", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    ).drop("_lines")
    return out.withColumn("n_repeat_words", repeated_words("_words")).drop("_words") if repeats else out


#: Times that a rule is evaluated on each row of the sample in one job, and jobs of which the fastest counts.
TIMES, RUNS = 8, 2


def greedy(rules: tuple[Rule, ...], costs: list[float], rejected: dict[tuple[bool, ...], int]) -> list[tuple[Rule, float]]:
    """The rules in the order of rejections per cost, each among rows that no rule before it rejects, with that share of those.

    `rejected` says of how many rows the sample has for each set of rules that reject them.
    """
    left, out = list(range(len(rules))), []
    while left:
        hits = {i: sum(n for by, n in rejected.items() if by[i]) for i in left}
        best = max(left, key=lambda i: (hits[i] / costs[i], -costs[i], -i))
        out.append((rules[best], hits[best] / max(1, sum(rejected.values()))))
        rejected = {by: n for by, n in rejected.items() if not by[best]}
        left.remove(best)
    return out


def costs(sample: DataFrame, rules: tuple[Rule, ...], n: int) -> list[float]:
    """Seconds a row of each rule, rounded to a power of four, so that noise doesn't order rules of like cost.

    A job evaluates the rule on each row many times, and the same job without the rule is taken off.
    """
    many = sample.withColumn("_time", F.explode(F.sequence(F.lit(1), F.lit(TIMES))))

    def seconds(condition: str) -> float:
        took = []
        query = many.agg(F.count(F.when(F.expr(condition) & (F.col("_time") > 0), 1)))
        for _ in range(RUNS + 1):  # the first compiles
            began = time.perf_counter()
            query.collect()
            took.append(time.perf_counter() - began)
        return min(took[1:])

    idle = seconds("length(t) < 0")
    found = [max(seconds(r.rejects) - idle, 0.0) / (n * TIMES) for r in rules]
    least = max(1e-6, 0.02 / (n * TIMES))  # below it a job's time says nothing
    return [4.0 ** round(math.log(max(x, least), 4)) for x in found]


def ordered(sample: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, float, float]]:
    """The rules in the cascade's order on `sample`, each with its share of the rows that come to it and its seconds a row.

    `sample` has t and the base columns and is small and cached.  On an empty sample the rules keep their order.
    """
    sets = sample.groupBy(*[F.expr(r.rejects).alias(f"r{i}") for i, r in enumerate(rules)]).count().collect()  # at most 2^rules rows
    n = sum(r["count"] for r in sets)
    if not n:
        return [(r, 0.0, 0.0) for r in rules]
    each = costs(sample, rules, n)
    by = dict(zip(rules, each, strict=True))
    return [(r, share, by[r]) for r, share in greedy(rules, each, {tuple(bool(x) for x in r[:-1]): r["count"] for r in sets})]


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, in this order, or null.  Later rules aren't evaluated."""
    out = None
    for r in rules:
        out = F.when(F.expr(r.rejects), F.lit(r.name)) if out is None else out.when(F.expr(r.rejects), F.lit(r.name))
    return F.lit(None).cast("string") if out is None else out


ADDED = ("t", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept", "_words", "_lines", "_row")


def rule_order(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> list[Rule]:
    """The cascade's order on about `sample_rows` rows, drawn by a hash of the text and kept in the executors."""
    total = docs.count()
    drawn = docs.select(F.col(text).alias("text")).withColumn("_place", F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1_000_003)))
    drawn = drawn.filter(F.col("_place") < math.ceil(1_000_003 * min(1.0, sample_rows / max(1, total)))).select("text").distinct()
    sample = base_columns(drawn, "text").persist()
    try:
        return [r for r, _, _ in ordered(sample, rules)]
    finally:
        sample.unpersist()


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """`docs` with base columns, base_failed, rejected_by and kept.

    base_failed: n_words < 50, or 100 * n_repeat_words > 50 * n_words.  kept: neither
    base_failed nor rejected by a rule.  About `sample_rows` rows are used to order
    the rules; every row gets the verdict of all rules.  Null and empty texts fail.
    rejected_by names one rule that holds; with several, which one depends on the order.
    Columns of `docs` named like the added ones are replaced.  An empty table gives no rows.
    """
    docs = docs.drop(*[c for c in ADDED if c != text])
    order = rule_order(docs, text, rules, sample_rows)
    # A filter on `kept` must not sink below the base columns: it would take copies of their expressions along and work out a
    # text's words anew for every use.  It can't pass the row number, which is never below 0.
    out = base_columns(docs, text).withColumn("_row", F.monotonically_increasing_id())
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(order)))
    return out.withColumn("kept", F.col("rejected_by").isNull() & (F.col("_row") >= 0)).drop("t", "_row")


def passing(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """The rows of `docs` that quality_rules keeps, as they are.

    The cascade stops here for good: repeated words, the dearest condition, are worked out only for texts that pass all
    others.  Rules that use n_repeat_words come after it.
    """
    docs_columns, names = docs.columns, [f"_c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    mine = names[docs_columns.index(text)]
    order = rule_order(docs.select(text), text, rules, sample_rows)
    late = [r for r in order if "n_repeat_words" in r.rejects]
    early = [r for r in order if r not in late]
    out = base_columns(own, mine, repeats=False).withColumn("_row", F.monotonically_increasing_id())
    out = out.filter((F.col("_row") >= 0) & (F.col("n_words") >= 50) & cascade(early).isNull())
    out = out.withColumn("n_repeat_words", repeated_words("_words")).withColumn("_row", F.monotonically_increasing_id())
    out = out.filter((F.col("_row") >= 0) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words")) & cascade(late).isNull())
    return out.select(*names).toDF(*docs_columns)
