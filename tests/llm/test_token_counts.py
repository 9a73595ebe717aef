from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from terrapane.llm.registry import vocabulary_path
from terrapane.llm.token_counts import Automaton, token_counts, vocabulary
from tests.llm.conftest import ODD


def greedy(word: bytes, vocab: set[bytes]) -> int:
    word, at, n = b" " + word, 0, 0
    while at < len(word):
        at = next(j for j in range(len(word), at, -1) if word[at:j] in vocab or j == at + 1)
        n += 1
    return n


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("ab c", min_size=1, max_size=5), max_size=12), st.lists(st.text("abcd", min_size=1, max_size=14), min_size=1, max_size=8))
def test_counts_are_greedy(vocab, words):
    pieces = {v.encode() for v in vocab}
    data = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - np.array([len(w) for w in words])
    got = Automaton(pieces).counts(data, start, end)
    assert got.tolist() == [greedy(w.encode(), pieces) for w in words]


def test_odd_tables(spark, odd, empty):
    vocab = vocabulary(vocabulary_path("byte_bpe_50k.tiktoken"))
    known = set(vocab)
    want = sorted((str(d), len((t or "").encode().split()), sum(greedy(w, known) for w in (t or "").encode().split())) for d, t, *_ in ODD if d != 6)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_tokens"]) for r in token_counts(odd, vocab).collect() if r["doc_id"] != 6)
    assert got == want
    assert token_counts(empty, vocab).count() == 0
