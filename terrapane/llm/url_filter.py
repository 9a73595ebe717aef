"""URL verdicts: rules on hosts and paths first, and a ratio of character models for all other URLs.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, learn
from the URLs that the rules decide.  Contexts of 0 to ORDER bytes are counted under
keys that hold them whole; counts too many to broadcast are joined.  A character's chance in a context is interpolated with its
chance in the next shorter one, by how many different counts the context has.  The
log-likelihood difference, a character, is compared with a threshold calibrated on
URLs that the models did not learn from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapane.llm.common import Words, pieces, staged, sums_by_text

ORDER = 5
#: Up to so many counts are broadcast; more are joined.
MOST_COUNTS = 2_000_000


@dataclass(frozen=True)
class UrlRule:
    """Holds for `host` and its subdomains if the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


RULES = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(rest, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of each URL, with a line feed as its end: a key of its context and one of context and byte, by order; and the URLs' bounds."""
    w = Words(texts)
    size = np.diff(w.text_at)
    at = np.concatenate([[0], np.cumsum(size + 1 + ORDER)])
    data = np.full(at[-1], 10, np.uint64)
    own = np.arange(len(w.data)) + np.repeat(at[:-1] + ORDER - w.text_at[:-1], size)
    data[own] = w.data
    place = np.ones(len(data), bool)
    for i in range(ORDER):
        place[at[:-1] + i] = False
    where = np.flatnonzero(place)
    context = np.empty((ORDER + 1, len(where)), np.int64)
    both = np.empty_like(context)
    key = np.zeros(len(where), np.int64)
    for o in range(ORDER + 1):
        if o:
            key |= data[where - o].astype(np.int64) << (8 * (o - 1))
        context[o] = key | _tag(0, o)
        both[o] = key << 8 | data[where].astype(np.int64) | _tag(1, o)
    return context, both, np.concatenate([[0], np.cumsum(size + 1)])


def _tag(pair: int, order: int, side: int = 0) -> int:
    return (side * 16 + pair * 8 + order) << 56


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of keys by class, which _tag adds to the key."""
    for batch in pieces(batches, "url"):
        good = np.array(batch.column("good").to_pylist(), np.int64)
        context, both, bound = slots(batch.column("url"))
        side = np.repeat(good, np.diff(bound)) * _tag(0, 0, 1)
        code, n = np.unique(np.concatenate([context + side, both + side]).ravel(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])


class Ratio:
    """Log-likelihood of URLs under the accepted less that under the rejected, a byte."""

    def __init__(self, code: np.ndarray, n: np.ndarray, strength: float = 4.0):
        order = np.argsort(code)
        self.code, self.n, self.strength = code[order], n[order], strength

    def count(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.code):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.code, keys), len(self.code) - 1)
        return np.where(self.code[at] == keys, self.n[at], 0)

    def __call__(self, urls: pa.Array) -> np.ndarray:
        context, both, bound = slots(urls)
        logs = []
        for side in (1, 0):
            p = np.full(context.shape[1], 1 / 256)
            for o in range(ORDER + 1):
                n, c = self.count(context[o] + _tag(0, 0, side)), self.count(both[o] + _tag(0, 0, side))
                p = (c + self.strength * p) / (n + self.strength)
            logs.append(np.log(p))
        return sums_by_text(logs[0] - logs[1], bound) / np.maximum(1, np.diff(bound))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's ORDER bytes and byte at each of its places."""
    for batch in pieces(batches, "url"):
        _, both, bound = slots(batch.column("url"))
        flat = pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(both[ORDER] - _tag(1, ORDER)))
        yield pa.RecordBatch.from_arrays([batch.column("url"), flat], ["url", "windows"])


def _joined_scores(urls: DataFrame, counts: DataFrame, strength: float = 4.0) -> DataFrame:
    """key (xxhash64 of the URL) and score of each distinct URL, as Ratio has it, with the counts looked up by a join."""
    found = staged(urls.select("url").distinct().mapInArrow(_windows, "url string, windows array<long>"), "windows")
    found = found.select(F.xxhash64("url").alias("key"), F.size("windows").alias("bytes"), F.explode("windows").alias("w"))
    names = {f"n{s}{pair}{o}": (s, pair, o) for s in (1, 0) for pair in (0, 1) for o in range(ORDER + 1)}
    wanted = [
        F.struct(F.lit(name).alias("name"), (F.shiftright("w", 8 * (1 - pair)).bitwiseAND(F.lit((1 << 8 * (o + pair)) - 1)) + F.lit(_tag(pair, o, s))).alias("code"))
        for name, (s, pair, o) in names.items()
    ]
    asked = found.select("w").distinct().select("w", F.explode(F.array(*wanted)).alias("x")).select("w", "x.*").join(counts, "code", "left")
    per = asked.groupBy("w").agg(*[F.coalesce(F.max(F.when(F.col("name") == name, F.col("n"))), F.lit(0)).alias(name) for name in names])
    for s in (1, 0):
        per = per.withColumn("p", F.lit(1 / 256))
        for o in range(ORDER + 1):
            per = per.withColumn("p", (F.col(f"n{s}1{o}") + strength * F.col("p")) / (F.col(f"n{s}0{o}") + strength))
        per = per.withColumn(f"log{s}", F.log("p"))
    per = per.select("w", (F.col("log1") - F.col("log0")).alias("ratio"))
    return found.join(per, "w").groupBy("key").agg((F.sum("ratio") / F.max("bytes")).alias("score"))


#: Scores are counted in bins of 1/FINE, those beyond FAR either way in the outermost.
FINE, FAR = 4096, 16


def threshold(bins: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the least sum of both classes' error rates; 0 where a class is missing.  Of equal cuts, the one nearest 0.

    Bin b, of which there are so many good and bad ones, holds the scores above (b - 1) / FINE up to b / FINE.
    """
    if not good.sum() or not bad.sum():
        return 0.0
    order = np.argsort(bins)
    bins, good, bad = bins[order], good[order], bad[order]
    cuts = np.unique(np.concatenate([bins, bins - 1, [0]]))
    below = np.searchsorted(bins, cuts, "right")  # bins whose scores are up to the cut
    error = np.append(0, np.cumsum(good))[below] / good.sum() + 1 - np.append(0, np.cumsum(bad))[below] / bad.sum()
    best = cuts[error <= error.min() + 1e-12]
    return float(best[np.argmin(np.abs(best))]) / FINE


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[UrlRule, ...] = RULES, most_counts: int = MOST_COUNTS) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row.

    score is the length-normalised log-likelihood difference; above the threshold the method allows.  URLs that a
    rule decides teach the models, but for a fifth, by a hash of the URL, all of which set the threshold.  A null
    URL, or one without ://, has empty host and path, no rule, and is scored as the empty URL or as it stands.
    Repeated URLs get equal verdicts.  An empty table gives no rows.  `most_counts` bounds the counts that are
    broadcast; with any value the scores are the same.
    """
    spark = pages.sparkSession
    kind = pages.schema[page_id].dataType.simpleString()
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "url", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"))
    taught = rows.filter("rule IS NOT NULL").select("url", (F.col("ruled") == "allow").cast("int").alias("good"))
    fold = F.pmod(F.xxhash64("url"), F.lit(5))
    counts = taught.filter(fold != 0).mapInArrow(_tally, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = staged(counts, "counts")
    small = counts.count() <= most_counts
    if small:
        table = counts.toArrow()
        shared = spark.sparkContext.broadcast(Ratio(table.column("code").to_numpy(), table.column("n").to_numpy()))
    else:
        by_url = staged(_joined_scores(rows, counts), "scores")

    def scored(extra: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "url"):
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in extra], pa.array(shared.value(batch.column("url")))], [*extra, "score"])

        return run

    held = taught.filter(fold == 0)
    if small:
        marks = held.mapInArrow(scored(["good"]), "good int, score double")
    else:
        marks = held.withColumn("key", F.xxhash64("url")).join(by_url, "key").select("good", "score")
    fine = F.ceil(F.least(F.greatest("score", F.lit(-float(FAR))), F.lit(float(FAR))) * FINE)
    marks = marks.groupBy(fine.alias("bin")).agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n")).toArrow()  # at most 2 * FAR * FINE + 1 rows
    bins, good, n = (marks.column(c).to_numpy() for c in ("bin", "good", "n"))
    cut = threshold(bins, good, n - good)
    if small:
        out = rows.mapInArrow(scored(["page_id", "host", "path", "rule", "ruled"]), f"page_id {kind}, host string, path string, rule string, ruled string, score double")
    else:
        out = rows.withColumn("key", F.xxhash64("url")).join(by_url, "key")
    # mapInArrow drops nothing: the url column stays behind once it is scored
    verdict = F.coalesce(F.col("ruled"), F.when(F.col("score") > cut, F.lit("allow")).otherwise(F.lit("block")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
