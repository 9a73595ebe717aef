"""A quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a logistic model on the
non-negative unbiased risk: with a share `prior` of good texts among all, the risk
of calling a bad text good is estimated from unlabelled texts less the positives'
part of it, and never taken below zero.  The features describe the whole text: how
its bytes fall into classes, how words repeat, and the shares of hashed word shapes,
words, pairs of neighbouring words and runs of three characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapane.llm.common import Words, crc_mod, lower_ascii, mix64, pieces, sums_by_text

SHAPES = 64
DENSE = 14
#: Slots of hashed words, word pairs and three-byte runs each; and the texts whose numbers are made at once.
GRAMS = 256
ROWS = 256
SIZE = DENSE + SHAPES + 3 * GRAMS
#: Classes of bytes: lower case, upper case, digits, sentence marks, other ASCII marks, beyond ASCII, white space.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 4
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[33, 34, 39, 44, 46, 58, 59, 63]] = 3
_CLASS[128:] = 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 6


def features(texts: pa.Array) -> np.ndarray:
    """A row of SIZE numbers for each text; a null or empty text has zeros."""
    parts = [_features(texts.slice(i, ROWS)) for i in range(0, len(texts), ROWS)]
    return np.concatenate(parts) if parts else np.zeros((0, SIZE), np.float32)


def _shares(text: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """For each text the square roots of its hashes' shares by slot, so that frequent ones don't drown the rest."""
    slot = (mix64(hashes) >> np.uint64(40)).astype(np.int64) % GRAMS
    counts = np.bincount(text * GRAMS + slot, minlength=n * GRAMS).reshape(n, GRAMS)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def _features(texts: pa.Array) -> np.ndarray:
    w = Words(texts)
    n = len(w.text_at) - 1
    kinds = _CLASS[w.data]
    size = np.diff(w.text_at)
    n_words = np.diff(w.first)
    out = np.zeros((n, SIZE))
    per_byte, per_word = 1.0 / np.maximum(size, 1), 1.0 / np.maximum(n_words, 1)
    for c in range(7):
        out[:, c] = sums_by_text((kinds == c).astype(np.int64), w.text_at) * per_byte
    bang = sums_by_text((w.data == 33).astype(np.int64), w.text_at)
    out[:, 7] = np.minimum(bang * per_word, 3)
    lengths = w.end - w.start
    out[:, 8] = np.minimum(sums_by_text(lengths, w.first) * per_word, 30) / 10
    out[:, 9] = np.log1p(n_words) / 10
    h = w.hashes()
    text = np.repeat(np.arange(n), n_words)
    # words equal to the one before, and distinct words and pairs of neighbours
    same = np.zeros(len(h), np.int64)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    out[:, 10] = sums_by_text(same, w.first) * per_word
    for column, key in ((11, h), (12, mix64(h + np.concatenate([h[1:], h[:1]]) * np.uint64(3)) if len(h) else h)):
        order = np.lexsort((key, text))
        k, t = key[order], text[order]
        first = np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])]) if len(k) else np.zeros(0, bool)
        out[:, column] = np.bincount(t[first], minlength=n) * per_word
    alone = (lengths == 1) & (kinds[w.start] >= 3) & (kinds[w.start] <= 4) if len(h) else np.zeros(0, bool)
    out[:, 13] = sums_by_text(alone.astype(np.int64), w.first) * per_word
    # a word's shape: the class of its first and of its last bytes, and whether it mixes case
    if len(h):
        f, l1, l2 = kinds[w.start].astype(np.int64), kinds[w.end - 1].astype(np.int64), kinds[np.maximum(w.end - 2, w.start)].astype(np.int64)
        shape = mix64(((f * 7 + l1) * 7 + l2).astype(np.uint64)) % np.uint64(SHAPES)
        flat = np.bincount(text * SHAPES + shape.astype(np.int64), minlength=n * SHAPES).reshape(n, SHAPES)
        out[:, DENSE : DENSE + SHAPES] = flat * per_word[:, None]
        at = DENSE + SHAPES
        out[:, at : at + GRAMS] = _shares(text, h, n)
        inner = text[1:] == text[:-1]
        out[:, at + GRAMS : at + 2 * GRAMS] = _shares(text[:-1][inner], h[:-1][inner] * np.uint64(3) + h[1:][inner], n)
        low = lower_ascii(w.data).astype(np.uint64)
        run = low[:-2] << np.uint64(16) | low[1:-1] << np.uint64(8) | low[2:]
        owner = np.repeat(np.arange(n), size)
        inner = owner[2:] == owner[:-2]
        out[:, at + 2 * GRAMS :] = _shares(owner[2:][inner], run[inner], n)
    return out.astype(np.float32)


class Model:
    """Scaled features, a linear score and its logistic."""

    def __init__(self, middle: np.ndarray, spread: np.ndarray, weight: np.ndarray, bias: float):
        self.middle, self.spread, self.weight, self.bias = middle, spread, weight, bias

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.middle) / self.spread, -8, 8) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def risk(w: np.ndarray, b: float, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, tuple[np.ndarray, float], tuple[np.ndarray, float]]:
    """Of positives p and unlabelled rows u: the risk of calling good texts bad, the unbiased risk of calling bad ones good, and both gradients.

    The losses are logistic: log(1 + e^-z) for a good text, log(1 + e^z) for a bad one.
    """
    zp, zu = p @ w + b, u @ w + b
    sp, su = (1 / (1 + np.exp(-np.clip(z, -50, 50))) for z in (zp, zu))
    good = prior * float(np.logaddexp(0, -zp).mean())
    bad = float(np.logaddexp(0, zu).mean()) - prior * float(np.logaddexp(0, zp).mean())
    good_by = prior * (p.T @ (sp - 1)) / len(p), prior * float((sp - 1).mean())
    bad_by = u.T @ su / len(u) - prior * (p.T @ sp) / len(p), float(su.mean()) - prior * float(sp.mean())
    return good, bad, good_by, bad_by


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 1000, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """Minimise the non-negative risk by gradient steps (Adam) on all rows given.

    Where the estimate of the second risk falls below zero, a step goes back from what overfits.
    """
    middle, spread = unlabelled.mean(axis=0, dtype=np.float64), unlabelled.std(axis=0, dtype=np.float64) + 1e-3
    p, u = (np.clip((x - middle) / spread, -8, 8).astype(np.float32) for x in (positive, unlabelled))
    w, b = np.zeros(p.shape[1], np.float32), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        _, bad, (gw, gb), (hw, hb) = risk(w, b, p, u, prior)
        gw, gb = (gw + hw, gb + hb) if bad >= 0 else (-hw, -hb)
        g = np.append(gw + decay * w, gb)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), float(b - step[-1])
    return Model(middle, spread, w.astype(float), b)


def classify(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", mod: int = 3, remainder: int = 1, most_rows: int = 4000
) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Positives are texts with label 1, of rows whose crc32(id) modulo `mod` isn't `remainder`; unlabelled ones are any
    texts of such rows.  About `most_rows` distinct rows of each (a fixed bound, drawn by a hash of id and text) fit the
    model; the prior is the share of 1 among the labels of such rows, which takes the labelled rows for a fair sample.
    A null text scores as an empty one, repeated rows score alike.  Without positives or texts to fit on, every score is
    the prior, and that is 0.5 without labels.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held = F.coalesce(crc_mod("doc_id", mod) == remainder, F.lit(False))
    marked = labels.select(F.col("doc_id"), F.col(label).alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).filter(~held)
    ones, known = marked.agg(F.coalesce(F.sum((F.col("label") == 1).cast("long")), F.lit(0)), F.count(F.lit(1))).collect()[0]
    prior = min(0.99, max(0.01, ones / known)) if known else 0.5
    trained = source.filter(~held & F.col("doc_id").isNotNull())
    total = trained.count()

    def place(column: Column, seed: int) -> Column:
        return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1_000_000_007)) / 1_000_000_007.0

    def vectors(df: DataFrame) -> np.ndarray:
        got = df.select("text").mapInArrow(_vector_rows, "x array<float>").toArrow()
        x = got.column("x").combine_chunks().flatten().to_numpy() if got.num_rows else np.zeros(0, np.float32)
        x = x.reshape(-1, SIZE)
        return x[np.lexsort(x.T[:DENSE])]  # the same order in any run

    text_id = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))
    chosen = marked.filter((F.col("label") == 1) & (place(F.col("doc_id").cast("string"), 9) < min(1.0, most_rows / max(1, ones)))).select("doc_id").distinct()
    positive = vectors(trained.join(chosen, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    unlabelled = vectors(trained.filter(place(text_id, 7) < min(1.0, most_rows / max(1, total))).dropDuplicates(["doc_id", "text"]))
    model = fit(positive, unlabelled, prior) if len(positive) and len(unlabelled) else None
    shared = spark.sparkContext.broadcast((model, prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, prior = shared.value
        for batch in pieces(batches, "text"):
            score = model(features(batch.column("text"))) if model else np.full(batch.num_rows, prior)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return source.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def _vector_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        x = features(batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], ["x"])
