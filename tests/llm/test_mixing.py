import random
from collections import defaultdict

import pytest

from terrapane.llm.mixing import mix, mixed, n_words, targets
from tests.llm.conftest import ODD, frame


def filled(sizes: dict, weights=(5, 2, 1), cap=3):
    """Targets by sharing again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, t = float(sum(sizes.values())), set(order), dict.fromkeys(order, 0.0)
    while free:
        share = left / sum(w[s] for s in free)
        over = {s for s in free if share * w[s] > cap * sizes[s]}
        if not over:
            return t | {s: share * w[s] for s in free}
        for s in over:
            t[s] = float(cap * sizes[s])
            left -= t[s]
        free -= over
    return t


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{i}" if i else None: r.choice([0, 1, 10, 500, 100_000]) for i in range(1 + 3 * seed)}
    got = {x["source"]: x["target"] for x in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = filled(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s], abs=1e-6) for s in want)


def test_taken_words(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.randrange(0, 40), "en", r.choice(["a", "a", "a", "b", "é", None]), 0) for i in range(3000)]
    df = frame(spark, rows)
    got = mix(df).collect()
    assert got and sorted(x["doc_id"] for x in got) == list(range(3000))
    taken, target, most = defaultdict(int), {}, defaultdict(int)
    for x in got:
        assert x["size"] == len(rows[x["doc_id"]][1].split()) and x["taken"] == x["copies"] * x["size"] and 0 <= x["copies"] <= 3
        taken[x["source"]] += x["taken"]
        target[x["source"]] = x["target"]
        most[x["source"]] = max(most[x["source"]], x["size"])
    for s in target:
        assert abs(taken[s] - target[s]) <= most[s]
    assert {(x["doc_id"], x["taken"]) for x in mix(df.repartition(7)).collect()} == {(x["doc_id"], x["taken"]) for x in got}
    rows_out = mixed(df)
    assert rows_out.columns == df.columns
    assert rows_out.count() == sum(x["copies"] for x in got)


def test_odd_tables(spark, odd, empty):
    assert mix(odd).count() == len(ODD)
    assert mix(empty).count() == 0 and mixed(empty).count() == 0
    got = {(r["doc_id"], r["text"]): r["n"] for r in odd.select("doc_id", "text", n_words("text").alias("n")).collect()}
    assert all(got[d, t] == len((t or "").encode().split()) for d, t, *_ in ODD)


def test_rows_without_ids_are_spread(spark):
    """Many documents without an id: their texts spread them over the hashes, so that their source still comes near its target."""
    rows = [(None, f"text {i} " + "w " * (i % 9), "en", "b" if i % 4 else "a", 0) for i in range(2000)]
    got = mix(frame(spark, rows)).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 12
