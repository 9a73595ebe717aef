"""Near-duplicates by order MinHash, verified by banded alignment.

A text is its words.  Its three-word k-mers, and the two-word ones too if it is short,
are labelled with their occurrence (the second time the same k-mer counts as another
one), each of several hash functions picks the smallest two, and they are kept in the
order in which they stand in the text.  Equal sketches make candidates; so texts meet
that share much, in the same order.  A candidate holds if the word-level edit distance
is at most 0.2 of the longer text's words; the alignment runs in a band of that width.

Exact copies are one node from the start.  In a bucket of equal sketches everyone is
first aligned with the smallest node; most links come from that, and make classes.
Buckets that still hold several classes are then searched whole: all pairs of nodes
from different classes whose lengths and word counts allow it are aligned, most alike
first, inside the task, which joins classes as it goes and emits links only.  A pair
is searched in one bucket of those it shares.  Buckets are cut into blocks of bounded
size, and each pair of blocks is a task's work.  Classes are the connected nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapane.llm.common import Words, mix64, only_kept, pieces, release, small, staged

#: Words of a k-mer, and for texts of at most SHORT words besides.
WIDE, NARROW, SHORT = 3, 2, 32
#: Hash functions.
FUNCTIONS = 28
#: A block of a bucket has about so many rows and words at most.
BLOCK_ROWS, BLOCK_WORDS = 2048, 1 << 20
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bins of the word counts that bound a distance from below.
BINS = 256


def kmers(hashes: np.ndarray, first: np.ndarray, k: int = WIDE) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mer hashes of all texts, in text order, and where each text's begin.

    A text of fewer than k words, but at least one, has a single k-mer of all its words.
    """
    n = np.diff(first)
    width = np.minimum(n, k)
    count = np.where(n > 0, n - width + 1, 0)
    at = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n)), count)
    place = first[text] + (np.arange(at[-1]) - at[text])
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    out = np.zeros(len(place), np.uint64)
    short = width[text]
    for j in range(k):
        out = out * _STEP + np.where(j < short, padded[place + j], np.uint64(j))
    out = mix64(out ^ short.astype(np.uint64))
    # occurrences: equal (text, k-mer) become neighbours, in text order
    key = mix64(out + text.astype(np.uint64) * _STEP)
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]]) if len(key) else np.zeros(0, bool)
    if same.any():
        run = np.arange(len(key)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
        nth = np.empty(len(key), np.uint64)
        nth[order] = run.astype(np.uint64)
        out = np.where(nth > 0, mix64(out + nth * _STEP), out)
    return out, at


def sketches(hashes: np.ndarray, first: np.ndarray, functions: int, k: int = WIDE) -> np.ndarray:
    """For each text the key of its two smallest k-mers, in text order, by hash function; rows of texts without words mean nothing.

    A text of one k-mer has that alone.
    """
    labelled, at = kmers(hashes, first, k)
    n = len(first) - 1
    out = np.zeros((n, functions), np.uint64)
    count = np.diff(at)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    begin = at[:-1][full]
    which = np.repeat(np.arange(len(full)), count[full])
    one = count[full] == 1
    top = np.uint64(2**64 - 1)
    for f in range(functions):
        v = labelled * (mix64(np.array([2 * f + 1], np.uint64))[0] | np.uint64(1))
        low = np.minimum.reduceat(v, begin)
        # equal values are equal k-mers, which the labels rule out: one place has the least
        v1 = np.flatnonzero(v == low[which])
        v[v1] = top
        second = np.minimum.reduceat(v, begin)
        v2 = np.flatnonzero(v == second[which])
        # hash collisions aside, v1 and v2 have one place for each text
        a = v1[np.searchsorted(v1, begin)]
        b = np.where(one, a, v2[np.minimum(np.searchsorted(v2, begin), len(v2) - 1)])
        key = mix64(np.full(len(full), f * 64, np.uint64) * _STEP + labelled[np.minimum(a, b)])
        out[full, f] = np.where(one, key, mix64(key * _STEP + labelled[np.maximum(a, b)]))
    return out


def candidate_keys(hashes: np.ndarray, first: np.ndarray, functions: int) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of all texts, one text's after another's, and how many each has: twice as many if it is short."""
    n = np.diff(first)
    short = np.flatnonzero(n <= SHORT)
    wide = sketches(hashes, first, functions, WIDE)
    own = np.repeat(n <= SHORT, n)
    narrow = mix64(sketches(hashes[own], np.concatenate([[0], np.cumsum(n[short])]), functions, NARROW))
    size = np.full(len(n), functions)
    size[short] *= 2
    begin = np.cumsum(size) - size
    out = np.empty(size.sum(), np.uint64)
    out[begin[:, None] + np.arange(functions)] = wide
    out[begin[short][:, None] + functions + np.arange(functions)] = narrow
    return out, size


def distance_within(a: list[int], b: list[int], most: int) -> bool:
    """Whether the word edit distance of a and b is at most `most`: a bit-parallel alignment in a band of that many words either way.

    A column of the band is one integer each of cells that are one more, or one less, than the cell above.
    """
    if abs(len(a) - len(b)) > most:
        return False
    i, least = 0, min(len(a), len(b))
    while i < least and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    i, least = 0, min(len(a), len(b))
    while i < least and a[-1 - i] == b[-1 - i]:
        i += 1
    a, b = a[: len(a) - i], b[: len(b) - i]
    if not a or not b:
        return True
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if most >= n:
        return True
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    # at column j, bit r of the band is row j - most + r; the lowest row is followed down to row n, and then row n
    width = 2 * most + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    up, down = mask ^ ((1 << most) - 1), 0
    score, last = most, n - most
    slack = most + m - last  # what row n can take back
    for j in range(1, m + 1):
        shift = j - most - 1
        eq = places.get(b[j - 1], 0)
        if eq:
            eq = (eq >> shift if shift >= 0 else eq << -shift) & mask
        same = ((((eq & up) + up) ^ up) | eq | down) & mask
        more, less = down | (mask ^ (same | up)), same & up
        if j <= last:
            if not same & top:
                score += 1
                if score > slack:
                    return False
        else:
            at = n - j + most
            score += (more >> at & 1) - (less >> at & 1)
        same >>= 1
        up, down = less | (mask ^ (same | more)), same & more
    return score <= most


def parities(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text BINS bits, as 64-bit integers: how many of its words fall to each bin, modulo 2."""
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    counts = np.bincount(text * BINS + (hashes >> np.uint64(32)).astype(np.int64) % BINS, minlength=n * BINS)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64).reshape(n, BINS // 64)


_BITS = [f"p{i}" for i in range(BINS // 64)]


def _sketch_rows(functions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            w = Words(batch.column("text"))
            h = w.hashes()
            keys, size = candidate_keys(h, w.first, functions)
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(keys.view(np.int64)))
            bits = parities(h, w.first)
            columns = [*[batch.column(c) for c in ("doc_id", "row", "node")], pa.array(np.diff(w.first)), *[pa.array(bits[:, i].copy()) for i in range(len(_BITS))], flat]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "node", "n", *_BITS, "keys"])

    return run


def _code_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """32 bits of each word's hash, for the alignment: two different words of a pair are taken for equal with probability 2^-32."""
    for batch in pieces(batches, "text"):
        w = Words(batch.column("text"))
        codes = (w.hashes() >> np.uint64(32)).astype("<u4")
        bounds = pa.py_buffer((w.first * 4).astype(np.int32).tobytes())
        enc = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, bounds, pa.py_buffer(codes.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column("node"), enc], ["node", "enc"])


def _changes(similarity: float):
    """How many changes of words texts of so many words may have; in integers, as SQL has it."""
    share = round((1 - similarity) * 10**9)

    def most(n: np.ndarray) -> np.ndarray:
        return n.astype(np.int64) * share // 10**9

    return most, f"CAST(floor(greatest(l.n, r.n) * {share}BD / 1000000000BD) AS INT)"


def _aligned(similarity: float):
    """The pairs (a, b, ea, eb) within the distance."""
    most, _ = _changes(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for ea, eb in zip(batch.column("ea"), batch.column("eb"), strict=True):
                a, b = np.frombuffer(ea.as_py(), "<u4").tolist(), np.frombuffer(eb.as_py(), "<u4").tolist()
                held.append(distance_within(a, b, int(most(np.array(max(len(a), len(b)))))))
            yield batch.select(["a", "b"]).filter(pa.array(held, pa.bool_()))

    return run


class Block:
    """Rows of one bucket: lengths, parities, classes, all keys, and on which side of the block each row is (0 or 1)."""

    def __init__(self, table: pa.Table, similarity: float):
        self.most, _ = _changes(similarity)
        self.n = table.column("n").to_numpy()
        self.bits = np.stack([table.column(p).to_numpy() for p in _BITS], axis=1).view(np.uint64)
        self.cls = table.column("class").to_numpy()
        self.side = table.column("side").to_numpy()
        self.alone = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        key = table.column("key")[0].as_py()
        lists = table.column("keys").combine_chunks()
        begin, flat = lists.offsets.to_numpy()[:-1], lists.values.to_numpy()
        # a sketch has its own place among all texts' keys: the rows agree on where this bucket's key stands
        place = int(np.flatnonzero(flat[begin[0] : lists.offsets[1].as_py()] == key)[0])
        self.before = flat[begin[:, None] + np.arange(place)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows from different classes that lengths and parities don't rule out, in the first bucket that they share."""
        rows = len(self.n)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        order = np.argsort(self.n, kind="stable")
        n, bits, cls, side = self.n[order], self.bits[order], self.cls[order], self.side[order]
        # a text's partners among longer ones end where even the longer one's changes don't make up for the lengths
        reach = np.searchsorted(n - self.most(n), n, "right")
        step = max(1, (1 << 20) // max(1, rows))
        for low in range(0, rows, step):
            x = np.arange(low, min(rows, low + step))
            y = np.arange(low, int(reach[x].max()))
            ok = (y[None, :] > x[:, None]) & (y[None, :] < reach[x][:, None]) & (cls[x][:, None] != cls[y][None, :])
            if not self.alone:
                ok &= side[x][:, None] != side[y][None, :]
            a, b = np.nonzero(ok)
            a, b = x[a], y[b]
            for part in range(0, len(a), 1 << 18):
                p, q = a[part : part + (1 << 18)], b[part : part + (1 << 18)]
                apart = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype=np.int64)
                keep = apart <= 2 * self.most(np.maximum(n[p], n[q]))
                p, q = order[p[keep]], order[q[keep]]
                first = ~(self.before[p] == self.before[q]).any(axis=1)
                found.append((p[first], q[first]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (key, i, j), block by block."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
        cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(ids[:, low].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _worth(similarity: float):
    """The rows of each block that have a pair to align."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            a, b = Block(table, similarity).pairs()
            if len(a):
                yield from table.take(np.unique(np.concatenate([a, b]))).to_batches()

    return run


def _linked(similarity: float):
    """Links (a, b) between classes, one for each two classes that a block joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            links = joined(table, similarity)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return run


def joined(table: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """Aligns a block's pairs, the most alike first, until none is left between different classes; the links found."""
    block = Block(table, similarity)
    a, b = block.pairs()
    if not len(a):
        return []
    enc = table.column("enc").combine_chunks()
    words: dict[int, np.ndarray] = {}
    for i in np.unique(np.concatenate([a, b])).tolist():
        words[i] = np.frombuffer(enc[i].as_py(), "<u4")
    # a changed word moves two of the counts by one at most
    counts = np.zeros((table.num_rows, BINS), np.uint8)
    for i, w in words.items():
        counts[i] = np.minimum(np.bincount(w % BINS, minlength=BINS), 255)
    apart = np.concatenate([np.abs(counts[a[i : i + 4096]].astype(np.int16) - counts[b[i : i + 4096]]).sum(axis=1) for i in range(0, len(a), 4096)])
    most = block.most(np.maximum(block.n[a], block.n[b]))
    keep = apart <= 2 * most
    order = np.argsort((apart[keep] / np.maximum(most[keep], 1)), kind="stable")
    a, b, most = a[keep][order], b[keep][order], most[keep][order]
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    links, lists = [], {}
    cls = block.cls.tolist()
    for x, y, d in zip(a.tolist(), b.tolist(), most.tolist(), strict=True):
        cx, cy = top(cls[x]), top(cls[y])
        if cx == cy:
            continue
        for z in (x, y):
            if z not in lists:
                lists[z] = words[z].tolist()
        if distance_within(lists[x], lists[y], d):
            root[max(cx, cy)] = min(cx, cy)
            links.append((min(cx, cy), max(cx, cy)))
    return links


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node it is connected with) of every node in links (a, b).

    Every node goes to the smallest of itself and its neighbours, and the links that are left join those.  A group's
    smallest node stays where it is, so that in the end the group is there; links to a common node go in one step.
    Nodes are hashes: along a chain they rise and fall at random, and rounds grow as the logarithm of its length.
    """
    edges, steps = staged(links.select("a", "b").distinct(), "edges"), []
    while not steps or edges.take(1):
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        step = staged(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("root")), "roots")
        steps.append(step)
        ra, rb = step.select(F.col("node").alias("a"), F.col("root").alias("ra")), step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = edges.join(ra, "a").join(rb, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        before, edges = edges, staged(left, "edges")
        release(before)
    release(edges)
    out = steps[-1]
    for step in reversed(steps[:-1]):
        further = out.select(F.col("node").alias("at"), F.col("root").alias("further"))
        out = step.join(further, step.root == further["at"], "left").select("node", F.coalesce("further", "root").alias("root"))
    out = staged(out, "components")
    for step in steps:
        release(step)
    return out


def _looked_up(left: DataFrame, table: DataFrame, on: str, total: int) -> DataFrame:
    """left join of `table`, which has each value of `on` once and in `rows` how many rows of left have it.

    At most 200 values can have more than a 200th of all rows: those are broadcast, so that no task gets one's rows.
    """
    hot = table.filter(F.col("rows") > total / 200).drop("rows")
    cold = table.filter(F.col("rows") <= total / 200).drop("rows")
    values = F.broadcast(hot.select(on))
    return left.join(F.broadcast(hot), on).unionByName(left.join(values, on, "left_anti").join(cold, on, "left"))


def text_node(text: str) -> Column:
    """What stands for a text: 64 bits, null for null."""
    return F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text)))


def _classes(source: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """node, best (the struct of the class's least row) and rows (how many have the node) of the nodes in classes of several rows."""
    named = staged(rows.filter("n > 0").select("node", "n", *_BITS, "keys").dropDuplicates(["node"]), "nodes")
    about = named.select("node", "n", *_BITS)
    _, most_sql = _changes(similarity)
    apart = " + ".join(f"bit_count(l.{p} ^ r.{p})" for p in _BITS)
    # members of buckets of two or more nodes, with their bucket's smallest node
    keyed = named.select("node", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("high")).filter("hub < high").select("key", "hub")
    # a table of its own next to the join: Spark splits a large key then
    hubs = staged(hubs, "hubs")
    shared = staged(keyed.join(small(hubs), "key"), "buckets")
    met = shared.filter("node <> hub").select("hub", "node").distinct()
    met = met.join(about.select(*[F.col(c).alias(f"l_{c}") for c in about.columns]), F.col("hub") == F.col("l_node"))
    met = met.join(about.select(*[F.col(c).alias(f"r_{c}") for c in about.columns]), F.col("node") == F.col("r_node"))
    most_met, apart_met = (x.replace("l.", "l_").replace("r.", "r_") for x in (most_sql, apart))
    pairs = staged(met.filter(F.expr(f"abs(l_n - r_n) <= {most_met} AND {apart_met} <= 2 * {most_met}")).select(F.col("hub").alias("a"), F.col("node").alias("b")), "pairs")
    links = staged(_verified(pairs, source, similarity), "links")
    roots = components(links)
    # the buckets that still hold several classes
    classed = shared.select("key", "node").join(small(roots), "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")
    mixed = classed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("key")
    mixed = staged(mixed, "mixed")
    members = staged(classed.join(small(mixed), "key").join(named.select("node", "n"), "node"), "members")
    sizes = members.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_WORDS)).cast("int").alias("salts"))
    sizes = staged(sizes, "sizes")
    placed = members.join(small(sizes), "key").join(named.drop("n"), "node").withColumn("salt", F.pmod(F.xxhash64("node", F.lit(5)), F.col("salts")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    dealt = dealt.withColumns({"i": F.least("salt", "other"), "j": F.greatest("salt", "other"), "side": (F.col("salt") > F.col("other")).cast("int")})
    columns = ["key", "i", "j", "side", "node", "class", "n", *_BITS, "keys"]
    schema = f"key long, i int, j int, side int, node long, class long, n long, {', '.join(f'{p} long' for p in _BITS)}, keys array<long>"
    worth = staged(_by_block(dealt.select(columns)).mapInArrow(_worth(similarity), schema), "worth")
    further = staged(_by_block(worth.join(_codes(source, worth.select("node").distinct()), "node").select(*columns, "enc")).mapInArrow(_linked(similarity), "a long, b long").distinct(), "links")
    if further.take(1):
        higher = components(further).select(F.col("node").alias("root"), F.col("root").alias("top"))
        # a class of one has no row in roots: it is its own root
        alone = higher.select(F.col("root").alias("node"), "top").join(roots, "node", "left_anti").select("node", F.col("top").alias("root"))
        merged = roots.join(small(higher), "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(alone)
        before, roots = roots, staged(merged, "components")
        release(before)
    # a node's copies first, then the classes, of which only those of several rows need a look
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("class_id"), F.col("row").alias("first"))).alias("least")
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(least, F.count(F.lit(1)).alias("rows")).join(small(roots), "node", "left")
    nodes = staged(nodes.select("node", F.coalesce("root", "node").alias("root"), "least", "rows"), "classes")
    classes = nodes.groupBy("root").agg(F.min("least").alias("best"), F.count(F.lit(1)).alias("nodes"), F.sum("rows").alias("all")).filter("all > 1")
    total = rows.count()
    of_node = _looked_up(nodes.select("node", "root", F.col("rows").alias("copies")), classes.select("root", "best", F.col("nodes").alias("rows")), "root", total)
    return staged(of_node.filter("best IS NOT NULL").select("node", "best", F.col("copies").alias("rows")), "kept")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, functions: int = FUNCTIONS) -> DataFrame:
    """doc_id, text_key, class_id and kept of every row.

    class_id is the class's smallest id, null if all of its ids are null.  kept holds for one row of each class: one
    with that id, and among such rows the first as they stand in the table.  text_key is the text's 64-bit hash.
    Texts are equal if these hashes are; other texts are compared by their words.  Empty texts are copies of each
    other; texts of white space alone match only copies.  A null text is a class of its own, and so stays; its
    class_id is its id.  An empty table gives no rows.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("node", text_node("text"))
    schema = f"doc_id {kind}, row long, node long, n long, {', '.join(f'{p} long' for p in _BITS)}, keys array<long>"
    rows = staged(source.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", "node", "text").mapInArrow(_sketch_rows(functions), schema), "sketches")
    with only_kept() as keep:
        total, of_node = rows.count(), keep(_classes(source, rows, similarity))
    ids = rows.select("doc_id", "row", "node")
    null, known = ids.filter("node IS NULL").withColumn("best", F.lit(None).cast(of_node.schema["best"].dataType)), ids.filter("node IS NOT NULL")
    out = _looked_up(known, of_node, "node", total).unionByName(null)
    return out.select(
        "doc_id",
        F.col("node").alias("text_key"),
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.class_id")).alias("class_id"),
        (F.col("best").isNull() | (F.col("best.first") == F.col("row"))).alias("kept"),
    )


def _by_block(df: DataFrame) -> DataFrame:
    return df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _codes(source: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and enc, the words' codes, of the texts of `nodes`."""
    texts = source.select("node", "text").join(small(nodes), "node", "left_semi").dropDuplicates(["node"])
    return texts.mapInArrow(_code_rows, "node long, enc binary")


def _verified(pairs: DataFrame, source: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are within the distance."""
    enc = staged(_codes(source, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()), "codes", "lz4")
    ea, eb = enc.select(F.col("node").alias("a"), F.col("enc").alias("ea")), enc.select(F.col("node").alias("b"), F.col("enc").alias("eb"))
    out = staged(pairs.join(ea, "a").join(eb, "b").select("a", "b", "ea", "eb").mapInArrow(_aligned(similarity), "a long, b long"), "verified")
    release(enc)
    return out
