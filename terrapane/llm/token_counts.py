"""Token counts by a linear longest-match automaton.

A word, with a space before it, is cut into word pieces greedily, the longest piece
first.  The vocabulary is a trie.  Where it can't go on from a node, the pieces that
greedy matching would have cut off by then are known beforehand, and so is the node
that stands for what is left (the failure link).  Each byte goes one node on, after
as many links as it takes, and a link leads to a shorter rest, so a word's links are
no more than its bytes; no piece is ever built.  Distinct words of a slice run side
by side.  The trie is packed: a node takes some twenty bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapane.llm.common import Words, pieces, sums_by_text
from terrapane.llm.tries import Packed, trie


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a file of lines "base64 rank", as the public rank files have them."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """A packed trie with, for each node, link, cut (pieces that the link pops) and ended (pieces that the end of a word pops there).

    Every single byte is a piece, whether the vocabulary has it or not, so that every word can be cut.
    """

    def __init__(self, vocab: Iterable[bytes]):
        children, ends = trie([bytes([b]) for b in range(256)] + [p for p in vocab if p])
        n = len(children)
        link, cut, ended = [0] * n, [0] * n, [0] * n
        level = [(0, b, c) for b, c in children[0].items()]
        while level:  # by depth: a link leads to a node less deep
            for v, b, c in level:
                if ends[c] >= 0:
                    cut[c] = 1
                else:  # what the parent's link has popped, then on from there by this byte
                    at, popped = link[v], cut[v]
                    while b not in children[at]:
                        popped += cut[at]
                        at = link[at]
                    link[c], cut[c] = children[at][b], popped
                ended[c] = cut[c] + ended[link[c]]
            level = [(c, b, k) for _, _, c in level for b, k in children[c].items()]
        self.trie = Packed(children)
        self.link, self.cut, self.ended = self.trie.spread(self.trie.place[link]), self.trie.spread(cut), self.trie.spread(ended)

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of each word data[start:end] with a space before it."""
        size = end - start
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        node = self.trie.step(np.zeros(len(order), np.int64), np.full(len(order), 32))
        found = np.zeros(len(order), np.int64)
        live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
        for i, k in enumerate(live):
            byte = data[start[:k] + i].astype(np.int64)
            to = self.trie.step(node[:k], byte)
            stuck = np.flatnonzero(to < 0)
            while len(stuck):
                at = node[stuck]
                found[stuck] += self.cut[at]
                node[stuck] = at = self.link[at]
                to[stuck] = self.trie.step(at, byte[stuck])
                stuck = stuck[to[stuck] < 0]
            node[:k] = to
        out = np.empty(len(order), np.int64)
        out[order] = found + self.ended[node]
        return out


def token_counts(docs: DataFrame, vocab: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens and n_bytes of every row; no words and no tokens for a null or empty text.

    Words are runs of anything but ASCII white space.  Ids may be null or repeat; other columns aren't read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Automaton(vocab))
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for batch in pieces(batches, "text"):
            w = Words(batch.column("text"))
            _, one, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
            counts = a.counts(w.data, w.start[one], w.end[one])[back]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(w.first)), pa.array(sums_by_text(counts, w.first)), pa.array(np.diff(w.text_at))],
                ["doc_id", "n_words", "n_tokens", "n_bytes"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, n_words long, n_tokens long, n_bytes long")
