import math
from collections import Counter
from zlib import crc32

import pyarrow as pa
import pytest

from terrapane.llm.common import Words
from terrapane.llm.lm_scoring import normal_bytes, score, window_scores, windows
from tests.llm.conftest import ODD, frame


def lower(b: bytes) -> bytes:
    return b.lower()


def plain(text) -> bytes:
    return b" ".join((text or "").encode().split()).lower() + b"\n"


def kt(n0, n1):
    p, a, b = 1.0, 0, 0
    for n, one in ((n0, 0), (n1, 1)):
        for _ in range(n):
            p *= ((b if one else a) + 0.5) / (a + b + 1)
            a, b = a + 1 - one, b + one
    return p


class Brute:
    """Weights by recursion over every context that was seen."""

    def __init__(self, texts, depth):
        self.depth = depth
        self.n = Counter()
        for t in texts:
            s = b"\n" * depth + plain(t)
            for i in range(depth, len(s)):
                for d in range(depth + 1):
                    for k in range(8):
                        self.n[s[i - d : i], s[i] >> (8 - k) | 1 << k, s[i] >> (7 - k) & 1] += 1
        self.seen = {(c, r) for c, r, _ in self.n}

    def own(self, c, r):
        return kt(self.n[c, r, 0], self.n[c, r, 1])

    def weighted(self, c, r):
        if len(c) == self.depth:
            return self.own(c, r)
        return (self.own(c, r) + math.prod(self.weighted(bytes([b]) + c, r) for b in range(256) if (bytes([b]) + c, r) in self.seen)) / 2

    def one(self, context, r):
        p, longer = 0.5, False
        for d in range(self.depth, -1, -1):
            c = context[len(context) - d :]
            if (c, r) not in self.seen:
                continue
            here = (self.n[c, r, 1] + 0.5) / (self.n[c, r, 0] + self.n[c, r, 1] + 1)
            ends = self.own(c, r) / 2 / self.weighted(c, r) if longer else 1.0
            p, longer = ends * here + (1 - ends) * p, True
        return p

    def log10(self, text):
        s, out = b"\n" * self.depth + plain(text), 0.0
        for i in range(self.depth, len(s)):
            for k in range(8):
                p = self.one(s[i - self.depth : i], s[i] >> (8 - k) | 1 << k)
                out += math.log10(p if s[i] >> (7 - k) & 1 else 1 - p)
        return out


def test_windows_and_bytes():
    texts = ["a  B\n", None, "", " x", "Éa"]
    w = Words(pa.array(texts))
    data, at = normal_bytes(w, 2)
    assert [data[a + 2 : b].tobytes() for a, b in zip(at, at[1:])] == [plain(t) for t in texts]
    keys, bound = windows(data, at, 2)
    for t, a, b in zip(texts, bound, bound[1:]):
        s = b"\n\n" + plain(t)
        assert [int(k) for k in keys[a:b]] == [int.from_bytes(s[i : i + 3]) for i in range(len(s) - 2)]


TEXTS = ["abra cadabra", "Abra bra", None, "cab ab", "dab  abra"]


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5])
def test_scores_are_the_recursion(spark, depth):
    """Every window, also those whose contexts were never seen in training, against the recursion over all contexts."""
    brute = Brute(TEXTS, depth)
    seen = Counter(int(k) for t in TEXTS for k in windows(*normal_bytes(Words(pa.array([t])), depth), depth)[0])
    asked = {int(k) for t in ["zebra", "ab ab", "x cadabry"] for k in windows(*normal_bytes(Words(pa.array([t])), depth), depth)[0]}
    rows = [(k, seen[k]) for k in seen.keys() | asked]
    got = window_scores(spark.createDataFrame(rows, "key long, n long"), depth).collect()
    assert sorted((r["key"], r["n"]) for r in got) == sorted(rows)
    for r in got:
        *context, byte = r["key"].to_bytes(depth + 1)
        want = 0.0
        for k in range(8):
            p = brute.one(bytes(context), byte >> (8 - k) | 1 << k)
            want += math.log10(p if byte >> (7 - k) & 1 else 1 - p)
        assert r["value"] == pytest.approx(want, abs=1e-9)


def test_next_bytes_sum_to_one(spark):
    seen = Counter(int(k) for t in TEXTS for k in windows(*normal_bytes(Words(pa.array([t])), 2), 2)[0])
    rows = {int.from_bytes(c + bytes([b])) for c in (b"ab", b"\n\n", b"zz", b"br") for b in range(256)}
    got = window_scores(spark.createDataFrame([(k, seen[k]) for k in rows | seen.keys()], "key long, n long"), 2)
    sums = Counter()
    for r in got.collect():
        sums[r["key"] >> 8] += 10 ** r["value"]
    assert all(sums[int.from_bytes(c)] == pytest.approx(1) for c in (b"ab", b"\n\n", b"zz", b"br"))


@pytest.mark.parametrize("most", [2_000_000, 3, 0])
def test_base_and_model(spark, most):
    """Whatever is broadcast, the scores are those of all windows and words."""
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(TEXTS * 6)] + [(i + 100, *r[1:]) for i, r in enumerate(ODD) if r[0] not in (5, 6)]
    held = {i: crc32(str(i).encode()) % 10 == 0 for i, *_ in rows}
    assert any(held.values())
    words = lambda t: plain(t).split() + ["END"]
    c = Counter(w for i, t, *_ in rows if not held[i] for w in words(t))
    n, v = sum(c.values()), len(c)
    brute = Brute([t for i, t, *_ in rows if not held[i]], 2)
    got = {r["doc_id"]: r for r in score(frame(spark, rows), depth=2, most_words=most, most_windows=most).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(words(t)), sum(c[w] > 0 for w in words(t)), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), abs=1e-9)
        assert r["score"] == pytest.approx(brute.log10(t), abs=1e-6)


def test_all_rows_held_out(spark):
    held = [i for i in range(200) if crc32(str(i).encode()) % 10 == 0]
    got = score(frame(spark, [(i, "ab c", "en", "a", 4) for i in held])).collect()
    assert len(got) == len(held) and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)
    assert all(r["score"] == pytest.approx(5 * 8 * math.log10(0.5)) for r in got)


def test_odd_tables(spark, odd, empty):
    got = score(odd).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert score(empty).count() == 0
