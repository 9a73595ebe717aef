import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from terrapane.llm.url_filter import FINE, ORDER, RULES, Ratio, _tally, judge, slots, threshold

URLS = [
    (1, "https://A.Example.NET/en/1?x"), (2, "http://example.net/EN/1"), (3, "http://net/"), (4, "http://net"), (5, "http://xnet/a"), (6, "http://b.example.com/de/?q"),
    (7, "http://example.com/d"), (8, "https://q.org/fr/#a"), (9, None), (10, ""), (11, "no scheme"), (12, "http://"), (13, "a://b://c.net/x"), (13, "a://b://c.net/x"),
    (None, "http://u.org/fr/x"), (14, "http://é.net/\n"), (15, "x" * 20_000 + "://h.net/" + "y" * 20_000), (16, "http://h.net?/en/"),
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "page_id long, url string, host string, rule string, score string")


def test_rules(spark):
    got = judge(table(spark, URLS)).collect()
    assert len(got) == len(URLS)
    want = sorted([(str(i), *brute(u)[:3]) for i, u in URLS], key=str)
    assert sorted([(str(r["page_id"]), r["host"], r["path"], r["rule"]) for r in got], key=str) == want
    ruled = {u: brute(u)[3] for _, u in URLS}
    for r in got:
        assert r["verdict"] in ("allow", "block")
    by_id = {r["page_id"]: r["verdict"] for r in got}
    assert all(by_id[i] == ruled[u] for i, u in URLS if ruled[u])
    assert judge(table(spark, [])).count() == 0


def test_method_learns_the_sides(spark):
    rows = [(i, f"http://site{i % 40}.org/fr/page{i}") for i in range(300)] + [(1000 + i, f"http://casino{i % 40}.net/win{i}") for i in range(300)]
    asked = [(5000, "http://site9.org/es/page77"), (5001, "http://casino9.biz/win77")]
    got = {r["page_id"]: r["verdict"] for r in judge(table(spark, rows + asked)).collect()}
    assert (got[5000], got[5001]) == ("allow", "block")


def by_hand(url, good, bad):
    """The definition: a byte's chance in each context is mixed with its chance in the next shorter one, by 4 against how often the context was seen."""
    line = lambda u: b"\n" * ORDER + (u or "").encode() + b"\n"
    logs = []
    for side in (good, bad):
        n, c = Counter(), Counter()
        for u in side:
            t = line(u)
            for i in range(ORDER, len(t)):
                for o in range(ORDER + 1):
                    n[t[i - o : i], o] += 1
                    c[t[i - o : i + 1], o] += 1
        t, total = line(url), 0.0
        for i in range(ORDER, len(t)):
            p = 1 / 256
            for o in range(ORDER + 1):
                p = (c[t[i - o : i + 1], o] + 4 * p) / (n[t[i - o : i], o] + 4)
            total += math.log(p)
        logs.append(total)
    return (logs[0] - logs[1]) / (len((url or "").encode()) + 1)


GOOD = ["http://a.org/fr/x", "http://ab.org/fr/abab", "http://a.org/fr/x", ""]
BAD = ["http://casino.net/win", "http://é.net/", "x"]


def test_ratio_is_the_interpolation():
    rows = [(u, 1) for u in GOOD] + [(u, 0) for u in BAD]
    batch = pa.RecordBatch.from_pydict({"url": [u for u, _ in rows], "good": pa.array([g for _, g in rows], pa.int32())})
    tallies = pa.Table.from_batches(list(_tally(iter([batch]))))
    ratio = Ratio(tallies.column("code").to_numpy(), tallies.column("n").to_numpy())
    asked = [*GOOD, *BAD, "ab", None, "http://b.org/es/ab", "ü"]
    assert ratio(pa.array(asked)).tolist() == pytest.approx([by_hand(u, GOOD, BAD) for u in asked])
    assert Ratio(np.zeros(0, np.int64), np.zeros(0, np.int64))(pa.array(["ab"])).tolist() == [0.0]


def test_threshold():
    """Against all cuts tried one by one on the binned scores."""
    r = random.Random(2)
    for _ in range(40):
        good, bad = ([r.gauss(m, 0.01) for _ in range(r.randrange(1, 30))] for m in (0.005, -0.004))
        bins = Counter()
        for x in good:
            bins[math.ceil(x * FINE), 1] += 1
        for x in bad:
            bins[math.ceil(x * FINE), 0] += 1
        b = np.array(sorted({k for k, _ in bins}))
        got = threshold(b, np.array([bins[k, 1] for k in b]), np.array([bins[k, 0] for k in b]))
        wrong = lambda c: sum(x <= c for x in good) / len(good) + sum(x > c for x in bad) / len(bad)
        least = min(wrong(k / FINE) for k in range(min(b) - 1, max(b) + 2))
        assert wrong(got) == pytest.approx(least)
        assert abs(got) == min(abs(k) / FINE for k in [0, *range(min(b) - 1, max(b) + 2)] if wrong(k / FINE) == pytest.approx(least))
    assert threshold(np.array([3]), np.array([0]), np.array([4])) == 0.0


def test_clashing_names_and_repeated_urls(spark):
    rows = [(i, f"http://s{i % 3}.org/fr/{i % 7}", "block", 1) for i in range(60)] + [(100 + i, "http://q.net/x", None, 2) for i in range(60)] + [(200 + i, "http://z.biz/fr/1", "x", 3) for i in range(5)]
    got = judge(spark.createDataFrame(rows, "page_id long, url string, verdict string, ruled int")).collect()
    assert len(got) == len(rows) and len({r["verdict"] for r in got if r["page_id"] >= 200}) == 1
    assert all(r["verdict"] == "allow" for r in got if r["page_id"] < 60) and all(r["verdict"] == "block" for r in got if 100 <= r["page_id"] < 160)


def test_contexts_are_counted_apart():
    urls = pa.array([f"http://h{i * 7919 % 100_003}.org/{i * 104_729 % 1_000_003}" for i in range(20_000)])
    context, both, _ = slots(urls)
    text = [f"\n\n\n\n\n{u}\n" for u in urls.to_pylist()]
    assert len(np.unique(both[5])) == len({t[i - 5 : i + 1] for t in text for i in range(5, len(t))})
    assert len(np.unique(context[5])) == len({t[i - 5 : i] for t in text for i in range(5, len(t))})


def test_joined_counts_give_the_same_scores(spark):
    rows = [(i, f"http://site{i % 40}.org/fr/page{i}") for i in range(100)] + [(1000 + i, f"http://casino{i % 40}.net/win{i}") for i in range(100)] + URLS
    a, b = (sorted((str(r["page_id"]), str(r["host"]), r["verdict"], round(r["score"], 9)) for r in judge(table(spark, rows), most_counts=m).collect()) for m in (10**6, 0))
    assert len(a) == len(rows) and a == b
