"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of one fixed public vocabulary.  A
word's probability is the sum over all its segmentations into pieces of the product
of their probabilities, which a forward pass over its bytes gives; a text's is the
product over its words.  Training runs a few rounds of expectation-maximisation on
the same sums.  Words are lower-cased and have a space before them.  The pass moves
over a word of any length in steps of STEP bytes; after each the sums are scaled by
the largest and the scale is kept as a logarithm, so that nothing underflows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapane.llm.common import Words, crc_mod, pieces, sums_by_text
from terrapane.llm.tries import Packed, trie

#: Bytes between scalings: sums of chances over so many bytes stay well within a double's range.
STEP = 16
#: Learning takes words of up to so many bytes side by side, and longer ones one by one in logarithms.
SHORT = 32


class Pieces:
    """The vocabulary as a packed trie; piece[v] is -1 where no piece ends.  Single bytes are pieces, whether the vocabulary has them or not."""

    def __init__(self, vocab: list[bytes]):
        pieces = list(dict.fromkeys([bytes([b]) for b in range(256)] + [p for p in vocab if p]))
        self.count, self.longest = len(pieces), max(map(len, pieces))
        children, ends = trie(pieces)
        self.trie = Packed(children)
        self.piece = self.trie.spread(ends)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return self.trie.step(node, byte)

    def spans(self, letter, i: int, size: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(end, rows, pieces) of the pieces that begin at byte i of words of so many bytes; letter(rows, j) is their byte j."""
        rows = np.flatnonzero(size > i)
        node = np.zeros(len(rows), np.int64)
        for j in range(i, i + self.longest):
            if j > i:
                keep = size[rows] > j
                rows, node = rows[keep], node[keep]
            node = self.step(node, letter(rows, j))
            keep = node >= 0
            rows, node = rows[keep], node[keep]
            if not len(rows):
                break
            found = self.piece[node]
            hit = found >= 0
            if hit.any():
                yield j + 1, rows[hit], found[hit]


def _letters(data: np.ndarray, start: np.ndarray):
    """Bytes of words with a space before them."""
    return lambda rows, j: data[start[rows] + j - 1].astype(np.int64) if j else np.full(len(rows), 32, np.int64)


def log_likelihoods(vocab: Pieces, chance: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, most_cells: int = 2_000_000) -> np.ndarray:
    """Natural log of each word's probability in each language; chance has a row for each piece."""
    total = np.zeros((len(start), chance.shape[1]))
    size = end - start + 1
    order = np.argsort(size, kind="stable")  # words of like sizes together
    at_once = max(1, most_cells // ((STEP + vocab.longest + 1) * max(1, chance.shape[1])))
    for low in range(0, len(order), at_once):
        rows = order[low : low + at_once]
        total[rows] = _forward(vocab, chance, _letters(data, start[rows]), size[rows])
    return total


def _forward(vocab: Pieces, chance: np.ndarray, letter, size: np.ndarray) -> np.ndarray:
    """Logs of the words' sums.  `size` rises, and `sums` has the bytes from `low` on of the words that go beyond it."""
    out = np.zeros((len(size), chance.shape[1]))
    most = int(size[-1])
    reach = min(vocab.longest, most)
    first = 0  # words before it have ended
    sums = np.zeros((STEP + reach + 1, len(size), chance.shape[1]))
    sums[0] = 1.0
    for low in range(0, most, STEP):
        own = size[first:]
        for i in range(low, min(low + STEP, most)):
            for j, rows, piece in vocab.spans(lambda r, j: letter(r + first, j), i, own):
                sums[j - low, rows] += sums[i - low, rows] * chance[piece]
        ended = int(np.searchsorted(own, low + STEP, "right"))
        out[first : first + ended] += np.log(sums[own[:ended] - low, np.arange(ended)])
        first += ended
        if first == len(size):
            break
        sums = np.concatenate([sums[STEP:, ended:], np.zeros((STEP, len(size) - first, chance.shape[1]))])
        scale = sums.max(axis=0)
        sums /= scale
        out[first:] += np.log(scale)
    return out


def learn(vocab: Pieces, words: list[bytes], counts: np.ndarray, rounds: int = 4, smoothing: float = 0.02) -> np.ndarray:
    """Piece probabilities, a column for each column of `counts` (words by languages)."""
    data = np.frombuffer(b"".join(words), np.uint8)
    width = np.array([len(w) for w in words], np.int64)
    start, size = np.cumsum(width) - width, width + 1
    languages = counts.shape[1]
    chance = np.full((vocab.count, languages), 1.0 / vocab.count)
    short, long = np.flatnonzero(size <= SHORT), np.flatnonzero(size > SHORT)
    short = short[np.argsort(size[short], kind="stable")]
    groups = [rows for rows in np.array_split(short, max(1, len(short) // 5_000)) if len(rows)]

    def spans(rows: np.ndarray) -> list:
        return [(i, *x) for i in range(int(size[rows].max())) for x in vocab.spans(_letters(data, start[rows]), i, size[rows])]

    for _ in range(rounds):
        expected = np.zeros((vocab.count, languages))
        for rows in groups:
            n, found = size[rows], spans(rows)
            forward = np.zeros((int(n.max()) + 1, len(n), languages))
            backward = np.zeros_like(forward)
            forward[0] = 1.0
            backward[n, np.arange(len(n))] = 1.0
            for i, j, at, piece in found:
                forward[j, at] += forward[i, at] * chance[piece]
            for i, j, at, piece in reversed(found):
                backward[i, at] += backward[j, at] * chance[piece]
            weight = counts[rows] / np.maximum(backward[0], 1e-300)
            for i, j, at, piece in found:
                np.add.at(expected, piece, forward[i, at] * chance[piece] * backward[j, at] * weight[at])
        logs = np.log(chance) if len(long) else chance
        for row in long:
            found = [(i, j, piece[0]) for i, j, _, piece in spans(np.array([row]))]
            forward = np.full((size[row] + 1, languages), -np.inf)
            backward = forward.copy()
            forward[0], backward[-1] = 0.0, 0.0
            for i, j, piece in found:
                forward[j] = np.logaddexp(forward[j], forward[i] + logs[piece])
            for i, j, piece in reversed(found):
                backward[i] = np.logaddexp(backward[i], backward[j] + logs[piece])
            for i, j, piece in found:
                expected[piece] += counts[row] * np.exp(forward[i] + logs[piece] + backward[j] - backward[0])
        expected += smoothing
        chance = expected / expected.sum(axis=0)
    return chance


def training_words(texts: pa.Array, languages: list[str], names: list[str]) -> tuple[list[bytes], np.ndarray]:
    """Distinct lower-cased words of whole texts, and how often each stands in each language."""
    seen: dict[bytes, int] = {}
    rows: list[tuple[int, int]] = []
    for t, lang in zip(pc.utf8_lower(texts).to_pylist(), languages, strict=True):
        column = names.index(lang)
        for w in t.encode().split():
            rows.append((seen.setdefault(w, len(seen)), column))
    counts = np.zeros((len(seen), len(names)))
    if rows:
        np.add.at(counts, tuple(np.array(rows).T), 1.0)
    return list(seen), counts


def _drawn(usable: DataFrame, rows_each: int) -> tuple[list[str], pa.Array]:
    """Languages and texts of about `rows_each` distinct rows of each language, the same in any run."""
    sizes = usable.groupBy("lang").count().collect()  # a row for each language
    if not sizes:
        return [], pa.array([], pa.string())
    # a place for each id and text, the same for any input; a language's share below it makes about rows_each rows
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text")), F.lit(1_000_000_007)) / 1_000_000_007.0
    share = F.element_at(F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, rows_each / r["count"])))]), F.col("lang"))
    drawn = usable.withColumn("place", place).filter(F.col("place") < share).dropDuplicates(["lang", "doc_id", "text"])
    # twice as many at most, should repeated rows have made the shares too large
    drawn = drawn.orderBy("place", "lang", "text").select("lang", "text").limit(2 * rows_each * len(sizes)).toArrow()
    order = np.argsort(np.array([f"{a}\0{b}" for a, b in zip(drawn.column(0).to_pylist(), drawn.column(1).to_pylist(), strict=True)], object), kind="stable")
    return [drawn.column(0)[int(i)].as_py() for i in order], drawn.column(1).combine_chunks().take(pa.array(order))


def identify(docs: DataFrame, vocab: list[bytes], doc_id: str = "doc_id", text: str = "text", lang: str = "lang", mod: int = 4, remainder: int = 2, rows_each: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    Rows whose crc32(id) modulo `mod` is `remainder`, and rows without an id, a text or a language, are not learned
    from.  About `rows_each` whole texts of each language (a fixed bound, drawn by a hash of id and text) train; every
    text is scored.  score is the language's posterior chance with equal priors; of languages with equal chances the
    first by name is taken.  A text without a letter, or a null one, is `und` with score 0, and so is every text if
    nothing could be learned.  Repeated rows are scored alike.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    held = F.coalesce(crc_mod("doc_id", mod) == remainder, F.lit(False))
    usable = source.filter(~held & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    langs, texts = _drawn(usable, rows_each)
    names, known = sorted(set(langs)), Pieces(vocab)
    chance = learn(known, *training_words(texts, langs, names)) if names else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast((known, names, chance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names, chance = shared.value
        for batch in pieces(batches, "text"):
            t = pc.utf8_lower(batch.column("text"))
            n = batch.num_rows
            letters = pc.fill_null(pc.match_substring_regex(t, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, score = np.zeros(n, np.int64), np.zeros(n)
            if names:
                w = Words(t)
                _, one, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
                each = log_likelihoods(known, chance, w.data, w.start[one], w.end[one])
                total = sums_by_text(each[back], w.first) if len(back) else np.zeros((n, len(names)))
                best = total.argmax(axis=1)
                score = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            said = letters & bool(names)
            pred = [names[b] if k else "und" for b, k in zip(best.tolist(), said.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(np.where(said, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    rows = source.select("doc_id", held.alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
