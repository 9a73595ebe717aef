"""Language-model scores by context-tree weighting over bytes.

A text is read as its words in lower case (A-Z), one space between them and a line
feed as the end.  Each byte is eight binary decisions; a decision's contexts are the
0 to `depth` bytes before it together with the bits already read.  Every context has
Krichevsky-Trofimov counts, and a context's weighted probability halves itself
between its own estimate and the product of its longer contexts, so that all
depths are mixed.  The counts are gathered once over all training texts; scoring
uses the tree as it then stands.  A path ends at the longest context that was seen.

No task and no worker holds the tree.  A window, the `depth` bytes before a byte and
the byte, has one score in all texts.  Windows are counted by key; those that share
their last three context bytes, 65,536 at most, meet in one task, which makes the
tree's nodes below those three bytes.  The shorter contexts are grouped sums of
those nodes.  A second pass over the same groups mixes all depths and gives each
window its score.  Texts then look up the frequent windows and words in broadcast
tables of at most `most_windows` and `most_words` rows and are joined with all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapane.llm.common import Words, held_out, lower_ascii, only_kept, pieces, staged, sums_by_text

END = np.uint64(0x5BD1E995ABCDEF01)
WORD_KIND, GRAM_KIND = 0, 1


def normal_bytes(w: Words, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as read, each after `depth` line feeds; and where each text's own bytes begin (one bound more than texts).

    Entry i of the bounds is where text i's line feeds begin, so its own bytes are [bound + depth, next bound).
    """
    n_words = np.diff(w.first)
    size = w.end - w.start
    text = np.repeat(np.arange(len(n_words)), n_words)
    total = sums_by_text(size + 1, w.first) + np.where(n_words == 0, 1, 0) + depth
    at = np.concatenate([[0], np.cumsum(total)])
    out = np.full(at[-1], 10, np.uint8)
    if len(size):
        before = np.cumsum(size + 1) - (size + 1)
        begin = at[text] + depth + before - before[w.first[text]]
        inside = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        source = np.repeat(w.start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out[inside] = lower_ascii(w.data[source])
        gaps = begin + size
        last = np.zeros(len(size), bool)
        last[w.first[1:][n_words > 0] - 1] = True
        out[gaps[~last]] = 32
    return out, at


def windows(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(depth + 1)-byte windows that end at each byte of each text, and the bounds of the texts among them."""
    key = np.zeros(max(0, len(data) - depth), np.uint64)
    for j in range(depth + 1):
        key = (key << np.uint64(8)) | data[j : len(data) - depth + j]
    own = np.ones(len(key), bool)
    for i in range(depth):  # windows that end in the line feeds before a text
        own[at[1:-1] - depth + i] = False
    size = np.diff(at) - depth
    return key[own], np.concatenate([[0], np.cumsum(size)])


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts."""
    if counts is None:
        keys = np.sort(keys)
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[edge], np.diff(np.append(edge, len(keys)))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[edge], np.add.reduceat(counts, edge) if len(edge) else counts[:0]


def _gather(depth: int, most: int = 1_000_000):
    """Words of training rows with their counts, and windows of all rows with their counts in training rows."""

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        return counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    def flush(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 200_000):
            k, c = keys[i : i + 200_000], counts[i : i + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], ["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {WORD_KIND: [], GRAM_KIND: []}
        for batch in pieces(batches, "text"):
            w = Words(batch.column("text"))
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            own = np.repeat(train, np.diff(w.first))
            kept[WORD_KIND].append(counted(w.hashes(lower_ascii(w.data))[own]))
            kept[WORD_KIND].append((np.array([END])[: int(train.any())], np.array([train.sum()])[: int(train.any())]))
            keys, bound = windows(*normal_bytes(w, depth), depth)
            kept[GRAM_KIND].append(counted(keys, np.repeat(train, np.diff(bound)).astype(np.int64)))
            for kind, parts in kept.items():
                if sum(len(p[0]) for p in parts) > most:
                    keys, counts = merged(parts)
                    if len(keys) > most // 2:
                        yield from flush(kind, keys, counts)
                        parts.clear()
                    else:
                        parts[:] = [(keys, counts)]
        for kind, parts in kept.items():
            if parts:
                yield from flush(kind, *merged(parts))

    return run


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = sum(np.log(x + i) for i in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - 1.1447298858494002


#: Context bytes that the windows of one task share.
SHARED = 3


class Nodes:
    """The tree's nodes of `depth` to `held` context bytes over some windows: of each node the zeros and ones after it.

    A node is its context bytes and the bits read so far.  Windows with count 0 have nodes too, which may be unseen.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, held: int):
        """All windows that share `held` context bytes with one of them are there."""
        byte, context = keys & np.uint64(255), keys >> np.uint64(8) << np.uint64(8)
        k = np.arange(8, dtype=np.uint64)[:, None]
        node = (context | (np.uint64(1) << k) | (byte >> (np.uint64(8) - k))).ravel()
        self.bit = ((byte >> (np.uint64(7) - k)) & np.uint64(1)).astype(bool)
        node, back = np.unique(node, return_inverse=True)
        self.back = back.reshape(8, len(keys))
        n = np.tile(counts.astype(float), 8)
        ones = np.bincount(back.ravel(), n * self.bit.ravel(), len(node))
        zeros = np.bincount(back.ravel(), n, len(node)) - ones
        weighted, ends = _estimate(zeros, ones), np.ones(len(node))
        #: By context bytes, the longest first: nodes, their tallies, the weight of ending there, and each node's place among those of one byte less.
        self.levels = []
        for d in range(depth, held - 1, -1):
            if d < depth:
                parent, up = np.unique(node & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
                self.levels[-1]["up"] = up
                node = parent
                zeros, ones, longer = (np.bincount(up, x, len(node)) for x in (zeros, ones, weighted))
                own = _estimate(zeros, ones)
                weighted = np.logaddexp(own, longer) - np.log(2)
                ends = 1 / (1 + np.exp(np.clip(longer - own, -700, 700)))
            self.levels.append({"node": node, "zeros": zeros, "ones": ones, "ends": ends})
        self.weighted = weighted

    def chances(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each bit and window: the chance of a one as far as `held` context bytes, whether that context was seen, and its place among its level's nodes."""
        at = self.back
        p, longer = np.full(at.shape, 0.5), np.zeros(at.shape, bool)
        for level in self.levels:
            zeros, ones = level["zeros"][at], level["ones"][at]
            seen, one = zeros + ones > 0, (ones + 0.5) / (zeros + ones + 1)
            ends = np.where(longer, level["ends"][at], 1.0)
            p = np.where(seen, ends * one + (1 - ends) * p, p)
            longer = seen
            last = at
            at = level["up"][at] if "up" in level else at
        return p, longer, last


def _groups(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[pa.Table]:
    """Rows sorted by `context`, about `most` at a time, each context whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) > most:
            table = pa.Table.from_batches(held)
            context = table.column("context").to_numpy()
            cut = int(np.searchsorted(context, context[-1]))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).combine_chunks().to_batches()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _grown(depth: int, held: int):
    """The nodes of `held` context bytes over all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            nodes = Nodes(table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy(), depth, held)
            last = nodes.levels[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (last["node"].view(np.int64), last["zeros"], last["ones"], nodes.weighted)], ["node", "zeros", "ones", "weighted"])

    return run


def _window_scores(depth: int, held: int):
    """key, n and log10 of the last byte's probability after the others, of each window; rows without a count are the nodes' tops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            is_top = table.column("n").is_null().to_numpy()
            top, own = table.filter(pa.array(is_top)), table.filter(pa.array(~is_top))
            if not own.num_rows:
                continue
            keys, n = own.column("key").to_numpy(), own.column("n").to_numpy()
            nodes = Nodes(keys.view(np.uint64), n, depth, held)
            p, seen, at = nodes.chances()
            name = top.column("key").to_numpy().view(np.uint64)
            order = np.argsort(name)
            place = order[np.searchsorted(name[order], nodes.levels[-1]["node"])]
            before, left, full = (top.column(c).to_numpy()[place][at] for c in ("before", "left", "full"))
            p = np.where(seen, before + left * p, full)
            value = np.log10(np.where(nodes.bit, p, 1 - p)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), pa.array(value)], ["key", "n", "value"])

    return run


def _estimate_sql(zeros: Column, ones: Column) -> Column:
    def lgamma(x: Column) -> Column:
        product, y = x, x + 8
        for i in range(1, 8):
            product = product * (x + i)
        return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.log(product)

    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - 1.1447298858494002


def _tops(low: DataFrame, held: int) -> DataFrame:
    """Of each node of `held` context bytes: before, left and full.

    With p as its chance from there on, the chance over all depths is before + left * p if the node was seen, else full.
    """
    levels = [low]
    for d in range(held - 1, -1, -1):
        up = levels[-1].withColumn("node", F.col("node").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)))
        up = up.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("longer"))
        up = up.withColumn("own", _estimate_sql(F.col("zeros"), F.col("ones")))
        high, least = F.greatest("own", "longer"), F.least("own", "longer")
        up = up.withColumn("weighted", high + F.log1p(F.exp(least - high)) - F.log(F.lit(2.0)))
        up = up.withColumn("ends", 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("longer") - F.col("own"))))))
        levels.append(staged(up.select("node", "zeros", "ones", "weighted", "ends"), f"level{d}"))
    state = None
    for d, level in enumerate(reversed(levels)):
        if state is None:
            now = level.withColumns({"_before": F.lit(0.0), "_left": F.lit(1.0), "_full": F.lit(0.5)})
        else:
            above = state.select(F.col("node").alias("_node"), F.col("before").alias("_before"), F.col("left").alias("_left"), F.col("full").alias("_full"))
            # a level of one context byte or none has 65,280 nodes at most
            above = F.broadcast(above) if d <= 2 else above
            now = level.join(above, F.col("node").bitwiseAND(F.lit((1 << 8 * d) - 1)) == F.col("_node"))
        if d == held:
            return now.select("node", F.col("_before").alias("before"), F.col("_left").alias("left"), F.col("_full").alias("full"))
        seen, one = F.col("zeros") + F.col("ones") > 0, (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
        here = F.col("_left") * one
        state = now.select(
            "node",
            F.when(seen, F.col("_before") + here * F.col("ends")).otherwise(F.col("_full")).alias("before"),
            F.when(seen, F.col("_left") * (1 - F.col("ends"))).otherwise(0.0).alias("left"),
            F.when(seen, F.col("_before") + here).otherwise(F.col("_full")).alias("full"),
        )


def window_scores(grams: DataFrame, depth: int) -> DataFrame:
    """key, n and value (log10 of the last byte's probability after the others) of each window, from windows with their training counts n."""
    held = min(SHARED, depth)

    def context(c: str) -> Column:
        return F.shiftright(c, 8).bitwiseAND(F.lit((1 << 8 * held) - 1)).alias("context")

    own = grams.select(context("key"), "key", "n")
    low = own.repartition("context").sortWithinPartitions("context").mapInArrow(_grown(depth, held), "node long, zeros double, ones double, weighted double")
    tops = _tops(staged(low, "nodes"), held)
    none = F.lit(None)
    both = own.select("context", "key", "n", *[none.cast("double").alias(c) for c in ("before", "left", "full")])
    both = both.unionByName(tops.select(context("node"), F.col("node").alias("key"), none.cast("long").alias("n"), "before", "left", "full"))
    return both.repartition("context").sortWithinPartitions("context").mapInArrow(_window_scores(depth, held), "key long, n long, value double")


class _Found:
    """Values of keys: sorted arrays, with a table in front where most keys are found at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 20):
        self.keys, self.values, self.shift = keys, values, np.uint64(64 - bits)
        self.slot_key = np.full(1 << bits, 2**64 - 1, np.uint64)
        self.slot_value = np.zeros(1 << bits, values.dtype)
        slot = (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
        self.slot_key[slot] = keys
        here = self.slot_key[slot] == keys  # of several keys for one place one stays
        self.slot_value[slot[here]] = values[here]

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's value, and whether it is there."""
        slot = (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
        out, hit = self.slot_value[slot], self.slot_key[slot] == keys
        missing = np.flatnonzero(~hit)
        if len(missing) and len(self.keys):
            one, back = np.unique(keys[missing], return_inverse=True)
            at = np.minimum(np.searchsorted(self.keys, one), len(self.keys) - 1)
            there = self.keys[at] == one
            out[missing], hit[missing] = self.values[at][back], there[back]
        return out, hit


def _head(table: DataFrame, value: str, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted keys and values of at most `most` rows, the frequent ones, and the least count among them; 0 if that is all rows."""
    least = _least_count(table, most)
    if least <= 1 and table.count() <= most:
        least = 0
    rows = table.filter(F.col("n") >= least).select("key", F.col(value).alias("v")).toArrow()
    keys, values = rows.column("key").to_numpy().view(np.uint64), rows.column("v").to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order], least


def _lists(values: np.ndarray, wanted: np.ndarray, bound: np.ndarray) -> pa.Array:
    """A list for each text of those of its values that are wanted."""
    at = np.concatenate([[0], np.cumsum(wanted)])[bound]
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values[wanted].view(np.int64)))


def score(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mod: int = 10, remainder: int = 0, depth: int = 4, most_windows: int = 1_500_000, most_words: int = 1_000_000
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row.

    Rows whose crc32(id) modulo `mod` is `remainder` are held out of training; rows without an id train.  A null
    or empty text is its end only.  Base: words and ends with add-0.1 smoothing over the training tokens.
    Repeated rows count as often as they stand there.  Without training rows a byte has eight even decisions.
    `most_windows` and `most_words` bound what is broadcast; other values give the same scores.  depth is 1 to 7.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out(doc_id, mod, remainder).alias("held_out"))
    gathered = source.select("text", "held_out").mapInArrow(_gather(depth), "kind int, key long, n long")
    table = staged(gathered.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = table.filter(F.col("kind") == WORD_KIND).select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).collect()[0]
    with only_kept() as keep:
        grams = keep(staged(window_scores(table.filter(F.col("kind") == GRAM_KIND).select("key", "n"), depth), "windows"))
    *gram_head, least_gram = _head(grams, "value", most_windows)
    *word_head, least_word = _head(words, "n", most_words)
    shared = spark.sparkContext.broadcast((gram_head, word_head))
    floor = total + 0.1 * (distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, word = (_Found(*x) for x in shared.value)
        for batch in pieces(batches, "text"):
            w = Words(batch.column("text"))
            window, bound = windows(*normal_bytes(w, depth), depth)
            value, here = gram(window)
            model = sums_by_text(np.where(here, value, 0.0), bound)
            rest = _lists(window, ~here, bound)
            n_words = np.diff(w.first)
            # an end after each text's words
            token = np.full(len(w.start) + len(n_words), END, np.uint64)
            token[np.arange(len(w.start)) + np.repeat(np.arange(len(n_words)), n_words)] = w.hashes(lower_ascii(w.data))
            first = w.first + np.arange(len(w.first))
            n, here = word(token)
            n = np.where(here, n, 0)
            settled = here | (least_word == 0)
            base = sums_by_text(np.where(settled, np.log10((n + 0.1) / floor), 0.0), first) if floor else np.zeros(batch.num_rows)
            known = sums_by_text((n > 0).astype(np.int64), first)
            tail = _lists(token, ~settled, first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(n_words + 1), pa.array(known), pa.array(base), pa.array(model), pa.array(np.diff(bound)), tail, rest],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes", "tail", "rest"],
            )

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long, tail array<long>, rest array<long>"
    scored = source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    if least_word or least_gram:
        scored = staged(scored, "scored")
        out = scored.drop("tail", "rest")
        if least_word:
            c = F.coalesce(F.col("n"), F.lit(0))
            tail = scored.select("row", F.explode("tail").alias("key")).join(words.filter(F.col("n") < least_word), "key", "left")
            tail = tail.groupBy("row").agg(F.sum(F.log10((c + 0.1) / floor)).alias("_base"), F.count("n").alias("_known"))
            out = out.join(tail, "row", "left").withColumn("base_score", F.col("base_score") + F.coalesce("_base", F.lit(0.0))).withColumn("n_known", F.col("n_known") + F.coalesce("_known", F.lit(0)))
        if least_gram:
            rest = scored.select("row", F.explode("rest").alias("key")).join(grams.filter(F.col("n") < least_gram).select("key", "value"), "key")
            out = out.join(rest.groupBy("row").agg(F.sum("value").alias("_score")), "row", "left").withColumn("score", F.col("score") + F.coalesce("_score", F.lit(0.0)))
        scored = out
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte")
    )


def _least_count(table: DataFrame, most: int) -> int:
    """The smallest count such that at most `most` rows of `table` have it or a larger one; at least 1.

    Counts are binned to a sixteenth of a power of two, so that few bins reach the driver.
    """
    octave = F.floor(F.log2("n") * 16).cast("int")
    bins = table.filter("n > 0").groupBy(octave.alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least")).orderBy(F.desc("bin")).collect()
    kept, least = 0, None
    for b in bins:
        kept += b["rows"]
        if kept > most:
            return least if least is not None else bins[0]["least"] + (1 << 62)
        least = b["least"]
    return 1
