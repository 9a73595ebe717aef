import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from terrapane.llm.common import Words, mix64
from terrapane.llm.near_duplicates import FUNCTIONS, candidate_keys, components, distance_within, kmers, near_duplicates, sketches
from tests.llm.conftest import ODD, frame


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def classes(docs):
    """Smallest ids of the groups that edit similarity of at least 0.8 connects."""
    ids = [d for d, *_ in docs]
    words = [(t or "").encode().split() for _, t, *_ in docs]
    bags = [Counter(w) for w in words]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            same = docs[i][1] is not None and docs[i][1] == docs[j][1]
            n = max(len(words[i]), len(words[j]))
            apart = n - sum((bags[i] & bags[j]).values())  # no alignment makes fewer changes
            if same or n and 5 * apart <= n and 5 * distance(words[i], words[j]) <= n:
                root[find(i)] = find(j)
    out = {}
    for i, d in enumerate(ids):
        out.setdefault(find(i), []).append(d)
    return {d: min(g) for g in out.values() for d in g}


def corpus():
    r = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for g in range(25):
        text = [r.choice(words) for _ in range(r.randrange(40, 160))]
        for c in range(r.randrange(1, 7)):
            copy = list(text)
            for _ in range(0 if c == 0 else r.randrange(0, len(text) // 30 + 1)):
                k = r.randrange(len(copy))
                copy[k : k + 1] = r.choice([[], ["new"], [copy[k], "new"]])
            docs.append(" ".join(copy))
    passage = " ".join(r.choice(words) for _ in range(55))
    docs += [f"{' '.join(r.choice(words) for _ in range(90))} {passage} {' '.join(r.choice(words) for _ in range(90))}" for _ in range(40)]
    docs += ["same text here and there"] * 50 + ["", "", " ", "one two", "one two"]
    r.shuffle(docs)
    return [(i, t, "en", "s", 0) for i, t in enumerate(docs)] + [(5000, None, "en", "s", 0), (5001, None, "en", "s", 0)]


def test_against_brute_force(spark):
    docs = corpus()
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in near_duplicates(frame(spark, docs)).collect()}
    want = classes(docs)
    assert len(got) == len(docs)
    assert {d: c for d, (c, _) in got.items()} == want
    assert all(k == (d == c) for d, (c, k) in got.items())


def test_order_and_occurrences_count():
    def key(t):
        w = Words(pa.array([t]))
        return sketches(w.hashes(), w.first, 8)[0].tolist()

    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    assert key(f"{a} {b}") == key(f"{a} {b}")
    forward, back = key(f"{a} {b}"), key(f"{b} {a}")
    assert sum(x == y for x, y in zip(forward, back)) < 8
    w = Words(pa.array(["x y z u v x y z u v x y z u v"]))
    labelled, at = kmers(w.hashes(), w.first)
    assert len(set(labelled.tolist())) == len(labelled) == at[-1] == 13


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(35 + 25 * seed)] + [(i, i + 1) for i in range(200, 260)] + [(300, 300 + i) for i in range(1, 40)]
    name = [r.getrandbits(62) for _ in range(400)]
    links = [(min(name[a], name[b]), max(name[a], name[b])) for a, b in links if a != b]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_odd_tables(spark, odd, empty):
    got = near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert sum(r["kept"] for r in got) == len(ODD) - 1 and all(r["class_id"] == r["doc_id"] for r in got if r["doc_id"] is not None)
    assert near_duplicates(empty).count() == 0
    assert sketches(np.zeros(0, np.uint64), np.zeros(1, np.int64), 16).shape == (0, 16)


@pytest.mark.parametrize("n", [1, 3, 9, 40, 600])
def test_sketches_are_the_smallest_in_order(n):
    r = random.Random(n)
    texts = [" ".join(f"w{r.randrange(50)}" for _ in range(n)) for _ in range(3)]
    w = Words(pa.array(texts))
    labelled, at = kmers(w.hashes(), w.first)
    got = sketches(w.hashes(), w.first, 3)
    for t in range(3):
        own = labelled[at[t] : at[t + 1]]
        for f in range(3):
            v = own * (mix64(np.array([2 * f + 1], np.uint64))[0] | np.uint64(1))
            key = np.array([f * 64], np.uint64)
            for x in own[np.sort(np.argsort(v, kind="stable")[:2])]:
                key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + x)
            assert got[t, f] == key[0]


def test_members_that_miss_the_hub_meet_each_other(spark):
    """Every pair of a bucket counts, not just those with its smallest node: groups of copies of one text, each pair within 0.8 and no two groups."""
    r = random.Random(5)
    docs = []
    for g in range(40):
        base = [f"g{g}w{i}" for i in range(100)]
        for c in range(3):  # edited at different places: 0.88 from the base, about 0.77 from each other
            copy = list(base)
            for k in r.sample(range(100), 12):
                copy[k] = f"g{g}c{c}x{k}"
            docs.append(" ".join(copy))
            near = list(copy)
            near[r.randrange(100)] = "other"
            docs.append(" ".join(near))
    docs = [(i, t, "en", "s", 0) for i, t in enumerate(docs)]
    got = {x["doc_id"]: x["class_id"] for x in near_duplicates(frame(spark, docs), functions=1).collect()}
    keys = {}
    for i, t, *_ in docs:
        w = Words(pa.array([t]))
        keys.setdefault(int(candidate_keys(w.hashes(), w.first, 1)[0][0]), []).append(i)
    words = [t.split() for _, t, *_ in docs]
    pairs = [(a, b) for m in keys.values() for a in m for b in m if a < b and 5 * distance(words[a], words[b]) <= 100]
    assert len(pairs) > 50
    assert all(got[a] == got[b] for a, b in pairs)


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2])
@pytest.mark.parametrize("n", [8, 10, 12, 20, 33, 60, 100, 300])
def test_recall_by_share_of_edits(n, share):
    """Scattered changes of words, as many as a similarity of 0.8 allows and fewer: such pairs become candidates."""
    r = random.Random(n)
    texts = []
    for i in range(300):
        base = [f"w{r.randrange(10**6)}" for _ in range(n)]
        copy = list(base)
        for k in r.sample(range(n), int(n * share)):
            copy[k] = f"x{i}y{k}"
        texts += [" ".join(base), " ".join(copy)]
    w = Words(pa.array(texts))
    keys, size = candidate_keys(w.hashes(), w.first, FUNCTIONS)
    at = np.concatenate([[0], np.cumsum(size)])
    own = [set(keys[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]
    assert sum(bool(own[i] & own[i + 1]) for i in range(0, 600, 2)) >= 270


@pytest.mark.parametrize("seed", range(3))
def test_banded_alignment(seed):
    r = random.Random(seed)
    for _ in range(1500):
        a = [r.randrange(r.choice([3, 9])) for _ in range(r.randrange(30))]
        b = list(a)
        for _ in range(r.randrange(9)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(2)] = [r.randrange(9)] * r.randrange(2)
        for most in range(0, 12, 3):
            assert distance_within(a, b, most) == (distance(a, b) <= most)


def test_blocks_of_a_bucket_lose_no_pair(spark, monkeypatch):
    """Tiny blocks, so that buckets are cut: the result is that of whole buckets."""
    docs = corpus()
    want = classes(docs)
    monkeypatch.setattr("terrapane.llm.near_duplicates.BLOCK_ROWS", 2)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(frame(spark, docs)).collect()}
    assert got == want


def test_repeated_rows_keep_one(spark):
    rows = [(1, "the same row here", "en", "a", 1)] * 3 + [(None, "only copies", "en", "a", 1)] * 2 + [(2, "only copies", "en", "a", 1), (3, None, "en", "a", 1)]
    got = sorted((str(r["class_id"]), str(r["doc_id"]), r["kept"]) for r in near_duplicates(frame(spark, rows)).collect())
    assert got == [("1", "1", False), ("1", "1", False), ("1", "1", True), ("2", "2", True), ("2", "None", False), ("2", "None", False), ("3", "3", True)]
