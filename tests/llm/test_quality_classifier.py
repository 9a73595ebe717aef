import numpy as np
import pyarrow as pa
import pytest

from terrapane.llm.quality_classifier import DENSE, GRAMS, ROWS, SHAPES, SIZE, classify, features, fit, risk
from terrapane.llm.registry import op9_quality_classifier
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op9_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out")
    r = got.selectExpr("avg(CAST(predicted = quality AS DOUBLE)) AS a", "avg(CASE WHEN quality = 0 THEN 1 - predicted END) AS bad", "count(*) AS n").first()
    assert r["n"] > 80 and r["a"] > 0.9 and r["bad"] > 0.8


def test_positives_and_unlabelled_part_two_groups():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(1.5, 1, (2000, 3)), rng.normal(-1.5, 1, (1000, 3))
    model = fit(good[:800], np.concatenate([good[800:], bad[:600]]), prior=2 / 3)
    assert (model(good) >= 0.5).mean() > 0.9 and (model(bad) < 0.5).mean() > 0.85


def test_features_of_odd_texts():
    x = features(pa.array([r[1] for r in ODD], pa.string()))
    assert x.shape == (len(ODD), SIZE) and np.isfinite(x).all()
    assert not x[0].any() and not x[1].any()


def test_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(i, q) for i, q in [(2, 1), (4, 1), (5, 0), (7, 1), (8, 0), (None, 1), (99, 1), (4, 1)]], "doc_id long, quality int")
    for lab in (labels, labels.limit(0)):
        got = classify(odd, lab).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
        assert classify(empty, lab).count() == 0
    again = [sorted((str(r["doc_id"]), r["score"]) for r in classify(odd.repartition(3), labels).collect()) for _ in range(2)]
    assert again[0] == again[1]


def test_risk_and_gradient_by_brute_force():
    """The risks by their definition, and the gradients by differences."""
    rng = np.random.default_rng(1)
    p, u, w, b, prior = rng.normal(1, 1, (7, 3)), rng.normal(0, 1, (11, 3)), rng.normal(0, 1, 3), 0.3, 0.6
    loss = lambda z: np.log1p(np.exp(-z))

    def brute(w, b):
        good = prior * sum(loss(x @ w + b) for x in p) / len(p)
        bad = sum(loss(-(x @ w + b)) for x in u) / len(u) - prior * sum(loss(-(x @ w + b)) for x in p) / len(p)
        return good, bad

    good, bad, (gw, gb), (hw, hb) = risk(w, b, p, u, prior)
    assert (good, bad) == pytest.approx(brute(w, b))
    e = 1e-6
    for k in range(3):
        d = e * np.eye(3)[k]
        up, down = brute(w + d, b), brute(w - d, b)
        assert (gw[k], hw[k]) == pytest.approx(((up[0] - down[0]) / 2 / e, (up[1] - down[1]) / 2 / e), abs=1e-6)
    up, down = brute(w, b + e), brute(w, b - e)
    assert (gb, hb) == pytest.approx(((up[0] - down[0]) / 2 / e, (up[1] - down[1]) / 2 / e), abs=1e-6)


def test_overfitting_is_stepped_back_from():
    """More numbers than rows: without the bound the second risk would fall without end; with it, it stays near zero."""
    rng = np.random.default_rng(2)
    p, u = rng.normal(0, 1, (30, 200)), rng.normal(0, 1, (30, 200))
    model = fit(p, u, 0.5, rounds=400, decay=0.0)
    q, v = (np.clip((x - model.middle) / model.spread, -8, 8) for x in (p, u))
    assert risk(model.weight, model.bias, q, v, 0.5)[1] > -0.2


def test_features_by_brute_force():
    """Rows don't depend on their neighbours, and the shares are those of the slots."""
    texts = ["Aa bb aa bb. 12", "aa", "x y  z!\n\nx", None, "", "é ü aa bb"] * (ROWS // 4)
    x = features(pa.array(texts, pa.string()))
    assert all(np.array_equal(x[i], features(pa.array([t], pa.string()))[0]) for i, t in enumerate(texts[:6]))
    grams = x[:, DENSE + SHAPES :].reshape(len(texts), 3, GRAMS).astype(float)
    sums = (grams**2).sum(axis=2)
    for t, got in zip(texts[:6], sums):
        n = len((t or "").split())
        assert got == pytest.approx([float(n > 0), float(n > 1), float(len((t or "").encode()) > 2)], abs=1e-6)
    # in "aa bb aa bb." of four words, "aa" has two; in "aa" one of one
    word = grams[1, 0].argmax()
    assert grams[1, 0, word] == 1.0 and grams[0, 0, word] ** 2 >= 0.2 - 1e-6
