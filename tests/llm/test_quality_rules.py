import random
import re
from collections import Counter

from pyspark.sql import functions as F

from terrapane.llm.quality_rules import RULES, Rule, base_columns, cascade, greedy, ordered, passing, quality_rules, rule_order
from tests.llm.conftest import ODD, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


def rejected(text):
    t = text or ""
    n_words, chars, symbols, dup, _, failed = base(text)
    lines = t.split("\n")
    return failed or 10 * symbols > 3 * n_words or 10 * t.count("!") > 3 * n_words or dup > 3 and 10 * dup > 3 * len(lines) or not 2 * n_words <= chars <= 15 * n_words or 2 * sum(c.isupper() for c in t) > chars or 5 * sum(c in "0123456789" for c in t) > 2 * chars


def texts(n=120):
    r = random.Random(4)
    out = []
    for i in range(n):
        words = [r.choice(["alpha", "b", "Cc", "dé", "!!", "#1", "42", "the", "of"] if i % 2 else [f"w{k}" for k in range(400)]) for _ in range(r.randrange(0, 140))]
        out.append("".join(w + r.choice([" ", " ", "\n", "\t", "\x0b "]) for w in words))
    return [*out, "a b c " * 30, "UPPER CASE " * 40, "1234 5678 " * 40]


def test_base_columns_and_verdict(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts())] + [(1000 + i, *r[1:]) for i, r in enumerate(ODD)]
    got = {r["doc_id"]: r for r in quality_rules(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(t), t
        assert r["kept"] == (not rejected(t)), t


def test_order_never_changes_the_verdict(spark):
    df = base_columns(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts(60))])).cache()
    verdicts = [df.select((cascade(list(o)).isNull()).alias("k"), "doc_id").orderBy("doc_id").collect() for o in (RULES, RULES[::-1])]
    assert verdicts[0] == verdicts[1]
    order = ordered(df)
    assert {r.name for r, _, _ in order} == {r.name for r in RULES}
    assert all(0 <= share <= 1 and cost > 0 for _, share, cost in order)


def test_greedy_is_conditional():
    """The second rule is the best for the rows that the first leaves, not for all."""
    a, b, c = (Rule(x, "true") for x in "abc")
    sets = {(True, True, False): 50, (True, False, False): 10, (False, True, False): 1, (False, False, True): 5, (False, False, False): 34}
    assert [(r.name, round(s, 3)) for r, s in greedy((a, b, c), [1.0, 1.0, 1.0], sets)] == [("a", 0.6), ("c", 0.125), ("b", round(1 / 35, 3))]
    assert [r.name for r, _ in greedy((a, b, c), [100.0, 1.0, 1.0], sets)] == ["b", "c", "a"]


def test_order_is_the_same_in_every_run(spark):
    df = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts(400))])
    slow = Rule("slow", "length(regexp_replace(t, '(a|b|c|d|e)+x', '')) < 0")
    orders = {tuple(r.name for r in rule_order(df, rules=(slow, RULES[0], RULES[3]), sample_rows=400)) for _ in range(4)}
    assert len(orders) == 1 and orders.pop()[-1] == "slow"


def test_passing_is_what_is_kept(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts())] + [(1000 + i, *r[1:]) for i, r in enumerate(ODD)]
    df = frame(spark, rows)
    rules = (*RULES, Rule("few_repeats", "n_repeat_words = 3"))
    got, want = passing(df, rules=rules), quality_rules(df, rules=rules).filter("kept")
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in want.collect())
    assert passing(df.limit(0)).count() == 0


def test_odd_tables(spark, odd, empty):
    assert quality_rules(odd).count() == len(ODD)
    assert quality_rules(empty).count() == 0
    assert cascade([]) is not None and spark.range(1).select(cascade([]).alias("x")).first()["x"] is None


def test_no_python_in_the_plan(spark, odd):
    plan = quality_rules(odd).filter(F.col("kept"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
