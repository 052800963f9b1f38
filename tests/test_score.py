"""Heads, temperature and thresholds against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import corpus as co
from tideline.operators import evaluate as ev
from tideline.operators import score as sc


def data(spark, n=300, k=3, d=5, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, d))
    y = rng.integers(0, k, n)
    x = (centres[y] + rng.normal(size=(n, d))).astype(np.float32)
    df = spark.createDataFrame([(i, f"c{y[i]}", [float(v) for v in x[i]]) for i in range(n)], "id long, truth string, embedding array<float>")
    return df, x.astype(float), y


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_scores_and_temperature(spark):
    df, x, y = data(spark)
    head = sc.centroid_head(df, "truth", F.col("embedding"), 5, 0.4)
    rows = sc.score_linear(df, head, keep_proba=True).orderBy("id").collect()
    p = softmax(x @ head.coef.T / 0.4)
    assert [r.top for r in rows] == [f"c{i}" for i in p.argmax(1)]
    assert np.allclose([r.proba for r in rows], p)
    assert np.allclose([r.entropy for r in rows], -(p * np.log(p)).sum(1) / math.log(3))
    t = sc.fit_temperature(sc.score_linear(df, head, keep_proba=True), head.classes, "truth")
    loss = lambda s: -np.log(softmax(x @ head.coef.T / s)[np.arange(len(y)), y]).mean()
    best = min(np.exp(np.linspace(math.log(0.05), math.log(20), 4000)), key=loss)
    assert abs(math.log(t / best)) < 0.02


def test_train_head_beats_chance_and_picks_least_loss(spark):
    df, _, _ = data(spark, 400)
    head, losses = sc.train_head(df.filter("id < 300"), df.filter("id >= 300"), "truth", c_grid=(0.01, 1.0), max_iter=50)
    right = sc.score_linear(df.filter("id >= 300"), head).filter("top = truth").count()
    assert losses[1.0] < losses[0.01] and right > 60


def test_choose_threshold_both_branches(spark):
    rng = np.random.default_rng(3)
    h = np.round(rng.random(500), 6)
    ok = rng.random(500) < 1 - h / 2
    df = spark.createDataFrame([(float(a), "x" if b else "y", "x") for a, b in zip(h, ok)], "entropy double, top string, truth string")
    cand = [t for t in (*np.unique(np.round(h, 4)), 1.0) if (h <= t).mean() >= 0.3]
    score = [((h <= t).mean(), ok[h <= t].mean(), t) for t in cand]
    for target in (0.99, 0.85):
        good = [s for s in score if s[1] >= target]
        want = max(good, key=lambda s: (s[0], -s[2]))[2] if good else max(score, key=lambda s: (s[1], s[0], -s[2]))[2]
        got = ev.choose_threshold(df, target).first()
        assert abs(got.threshold - want) < 1e-9 and got.reached == bool(good)


def test_sweep_marks_the_saved_threshold(spark):
    df = spark.createDataFrame([(0.2, "a", "a"), (0.6, "a", "b"), (0.9, "b", "b")], "entropy double, top string, truth string")
    rows = {r.threshold: r for r in ev.threshold_sweep(df, 0.6180).collect()}
    assert rows[0.618].saved and rows[0.1].precision is None and rows[0.1].handoff_rate == 1.0
    assert rows[0.618].error_rate == round(1 / 3, 6)


def test_delivery_outcomes(spark):
    cases = [(201, '{"SMSMessageData": {"Recipients": [{"n": 1}]}}', "delivered"), (201, '{"SMSMessageData": {"Recipients": []}}', "nobody"),
             (201, '{"SMSMessageData": {"Message": "x"}}', "nobody"), (200, "oops", "unreadable"), (200, "{}", "unreadable"), (500, "{}", "refused")]
    df = spark.createDataFrame(cases, "s int, b string, want string")
    assert all(r[0] == r[1] for r in df.select("want", ev.delivery_outcome(F.col("s"), F.col("b"))).collect())


def test_missing_vectors_have_no_score(spark):
    df, _, _ = data(spark, 40)
    head = sc.centroid_head(df, "truth", F.col("embedding"), 5, 0.4)
    holes = df.withColumn("embedding", F.when(F.col("id") % 3 != 0, F.col("embedding")))
    rows = {r.id: r.top for r in sc.score_linear(holes, head).collect()}
    whole = {r.id: r.top for r in sc.score_linear(df, head).collect()}
    assert all(rows[i] == (whole[i] if i % 3 else None) for i in whole)


def test_train_head_equals_a_plain_fit(spark):
    """The same penalised loss by plain gradient steps in numpy; the gradient of Spark's sums vanishes at both heads and nowhere near."""
    df, x, y = data(spark, 300)
    head, losses = sc.train_head(df, df, "truth", c_grid=(0.1,), max_iter=200)
    codes = np.array([head.classes.index(f"c{c}") for c in y])
    k, n = len(head.classes), len(codes)
    target, weight = np.eye(k)[codes], (n / (k * np.bincount(codes, minlength=k)))[codes]
    coef, bias = np.zeros((k, x.shape[1])), np.zeros(k)
    for _ in range(20_000):
        error = (softmax(x @ coef.T + bias) - target) * weight[:, None] / n
        coef, bias = coef - (error.T @ x + coef / (0.1 * n)), bias - error.sum(0)
    centred = lambda a: a - a.mean(0)
    assert np.abs(centred(head.coef) - centred(coef)).max() < 1e-3 and np.abs(centred(head.intercept) - centred(bias)).max() < 1e-3
    plain = sc.LinearHead(head.classes, coef + 0.01, bias)
    steep = lambda h: sc.head_gradient(df, h, "truth", 0.1).agg(F.max(F.abs("gradient"))).first()[0]
    assert steep(head) < 1e-5 and steep(sc.LinearHead(head.classes, coef, bias)) < 1e-5 < steep(plain)


def test_groups_that_straddle_raise(spark):
    df = spark.createDataFrame([("g", "train"), ("h", "test"), ("g", "test")], "group string, split string")
    with pytest.raises(ValueError, match="more than one split: g"):
        co.without_straddling(df)
    assert co.without_straddling(df.filter("group = 'h'")).count() == 1
