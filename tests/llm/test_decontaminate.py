import random
import re
from itertools import combinations

import pytest

from terrapane.llm.decontaminate import SHAPES, SHORTEST, contamination, decontaminated, parts
from tests.llm.conftest import ODD, frame

PUNCT = re.compile(r"[!-/:-@\[-`{-~]+")


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", PUNCT.sub("", (t or "").lower())) if w]


def brute(text, item, window=13, share=0.8):
    a, b = words(text), words(item)
    best = 0.0
    if len(b) < SHORTEST:
        return 0.0
    for lie in range(-len(b), len(a)):
        same = [0 <= i + lie < len(a) and b[i] == a[i + lie] for i in range(len(b))]
        w = min(window, len(b))
        best = max(best, max(sum(same[i : i + w]) for i in range(len(b) - w + 1)) / w)
    return best if best >= share else 0.0


@pytest.fixture(scope="module")
def cases():
    r = random.Random(7)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(n))) for i, n in enumerate([30, 8, 9, 7, 20, 14, 0, 25, 3, 5, 6, 2])] + [(None, " ".join(r.choice(vocab) for _ in range(16))), (99, None), (98, "v1 v2"), (97, "v9 v8 v7"), (96, "V9, v8 v7!")]
    docs = []
    for i in range(150):
        text = [r.choice(vocab) for _ in range(r.randrange(0, 60))]
        item = (r.choice(items)[1] or "").split()
        if i % 3 and item:
            part = item if i % 2 else item[r.randrange(len(item)) :]
            part = [w if r.random() > 0.12 else "other" for w in part]
            at = r.randrange(len(text) + 1)
            text = text[:at] + [w.upper() + "," if i % 5 == 0 else w for w in part] + text[at:]
        docs.append((i, " ".join(text), "en", "s", 0))
    return docs + [(1000 + i, *x[1:]) for i, x in enumerate(ODD)] + [(7, "another text under one id", "en", "s", 0)], items


@pytest.mark.parametrize("seeds", [300_000, 0])
def test_against_brute_force(spark, cases, seeds):
    docs, items = cases
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminated(frame(spark, docs), bench, broadcast_seeds=seeds).collect()
    assert len(got) == len(docs)
    by_row = {(r["doc_id"], r["text"]): r for r in got}
    hits = 0
    for i, t, *_ in docs:
        want = {k: brute(t, x) for k, x in items}
        want = {k: v for k, v in want.items() if v}
        r = by_row[i, t]
        assert set(r["items"]) == {k for k in want if k is not None}
        assert r["contaminated"] == bool(want) and r["matched"] == pytest.approx(max(want.values(), default=0))
        hits += bool(want)
    assert hits > 30


def test_odd_tables(spark, odd, empty):
    bench = spark.createDataFrame([(1, "lorem ipsum dolor sit amet consectetur lorem ipsum dolor")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminated(odd, bench).collect() if r["contaminated"]} == {5}
    assert decontaminated(empty, bench).count() == 0
    assert contamination(odd, bench.limit(0)).count() == 0
    assert decontaminated(odd, bench.limit(0)).count() == len(ODD)


@pytest.mark.parametrize("n", range(8, 14))
def test_seeds_hit_all_changes_the_rule_allows(n):
    lost = max(k for k in range(n) if (n - k) / n >= 0.8)
    for bad in combinations(range(n), lost):
        assert any(not {i + o for o in shape} & set(bad) for shape in SHAPES for i in range(n - shape[-1])), bad


def test_adjacent_and_outer_changes(spark):
    """Copies in which any two words (one of an item of eight or nine) differ, alone in their text or at its ends."""
    items, docs = [], []
    for n in (8, 9, 10, 11, 12, 13):
        item = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for bad in combinations(range(n), 1 if n < 10 else 2):
            copy = " ".join("other" if k in bad else x for k, x in enumerate(item))
            docs += [(len(docs) + i, t, "en", "s", n) for i, t in enumerate([copy, f"one two three {copy}", f"{copy} one two three"])]
        # the text ends in the item, or begins in it
        docs += [(len(docs) + i, t, "en", "s", n) for i, t in enumerate([f"one two three {' '.join(item[:-1])}", f"{' '.join(item[1:])} one two three"])]
    items.append((15, " ".join(f"i15w{k}" for k in range(15))))
    docs.append((len(docs), " ".join("other" if k in (6, 7) else f"i15w{k}" for k in range(15)), "en", "s", 15))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for seeds in (300_000, 0):
        got = {r["doc_id"]: r["items"] for r in contamination(frame(spark, docs), bench, broadcast_seeds=seeds).collect()}
        assert got == {d: [n] for d, *_, n in docs}


@pytest.mark.parametrize("n", range(3, 8))
def test_parts_of_short_items_are_complete(n):
    lost = max(k for k in range(n) if (n - k) / n >= 0.8)
    assert sorted(x for p in parts(n, 0.8) for x in p) == list(range(n))
    for bad in combinations(range(n), lost):
        assert any(not set(p) & set(bad) for p in parts(n, 0.8))


def test_short_items_and_texts(spark):
    """Items of three to seven words, with the one change that five and more allow, in texts that may be as short."""
    items = [(n, " ".join(f"s{n}w{k}" for k in range(n))) for n in range(1, 9)]
    docs, want = [], {}
    for n, item in items[2:]:
        w = item.split()
        for bad in [None, *range(n)]:
            copy = " ".join("other" if k == bad else x for k, x in enumerate(w))
            for t in (copy, f"before {copy}", f"{copy} after that"):
                docs.append((len(docs), t, "en", "s", 0))
                if bad is None or n >= 5:
                    want[len(docs) - 1] = [n]
    docs.append((len(docs), " ".join(f"s8w{k}" for k in range(7)), "en", "s", 0))
    want[len(docs) - 1] = [8]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for seeds in (300_000, 0):
        got = {r["doc_id"]: r["items"] for r in contamination(frame(spark, docs), bench, broadcast_seeds=seeds).collect()}
        assert got == want
