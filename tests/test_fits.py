"""Batched fits against plain Newton steps, and orderings in blocks against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilework.operators import learning, metrics, optimise, pooling
from tilework.plans.cohort_queries import QUERIES
from tilework.operators.tiles import hash_order

SF = "/root/testdata/sf0.001"


def newton(x, y, reg):
    """Plain logistic regression, the intercept free."""
    a = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(a.shape[1]), np.diag([reg] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        g = a.T @ (p - y) / len(y) + ridge @ w
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(y) + ridge, g)
    return w


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    y = (x @ rng.normal(size=6) + rng.normal(size=300) > 0.3).astype(int)
    return x, y, spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))], "id int, v array<double>, y int").repartition(5)


def test_models_of_one_pass_equal_newton(points, monkeypatch):
    x, y, frame = points
    monkeypatch.setattr(learning, "SUMMED_AT_ONCE", 2)
    made = learning.fit_logistic(frame, "v", "y", F.array(F.lit(True), F.col("id") % 2 == 0, F.col("id") < 0), [0.01, 0.3, 0.1])
    assert np.allclose(made[0], newton(x, y, 0.01), atol=1e-4) and np.allclose(made[1], newton(x[::2], y[::2], 0.3), atol=1e-4)
    assert not made[2].any()  # no rows
    assert learning.fit_logistic(frame.limit(0), "v", "y", F.array(F.lit(True)), [0.1]).shape == (1, 1)


def test_probe_is_the_mean_of_its_models(points):
    x, y, frame = points
    drawn = {(r.id, m) for m in range(3) for r in frame.select("id", hash_order("id", seed=m).alias("h")).collect() if int(r.h[:8], 16) < 0.5 * 2**32}
    ws = [newton(x[k], y[k], 0.01) for m in range(3) for k in [[i for i in range(300) if (i, m) in drawn]]]
    want = np.mean([1 / (1 + np.exp(-(x @ w[:6] + w[6]))) for w in ws], 0)
    got = {r.id: (r.label, r.p) for r in learning.linear_probe(frame, frame, "id", "v", "y", 0.5, 3).collect()}
    assert all(got[i][0] == y[i] and abs(got[i][1] - want[i]) < 1e-4 for i in range(300))


def plain_auc(s, y):
    wins = [(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]]
    return round(float(np.mean(wins)), 6) if wins else None


def test_nested_cv_equals_a_plain_one(points):
    x, y, frame = points
    fold = lambda seed, k: np.array([int(r.h[:8], 16) % k for r in sorted(frame.select("id", hash_order("id", seed=seed).alias("h")).collect(), key=lambda r: r.id)])
    outer, inner, grid = fold(1, 3), fold(2, 2), [0.001, 0.5]
    score = lambda w, k: x[k] @ w[:6] + w[6]
    for r in learning.nested_cv(frame, "id", "v", "y", grid, 3, 2).collect():
        means = [np.mean([plain_auc(score(newton(x[(outer != r.split) & (inner != i)], y[(outer != r.split) & (inner != i)], g), (outer != r.split) & (inner == i)), y[(outer != r.split) & (inner == i)]) for i in range(2)]) for g in grid]
        assert r.reg == grid[int(np.argmax(means))] and abs(r.inner_auc - max(means)) < 1e-3
        assert abs(r.auc - plain_auc(score(newton(x[outer != r.split], y[outer != r.split], r.reg), outer == r.split), y[outer == r.split])) < 1e-3


def test_linear_probe_query_repeats(spark):
    first = {r.image_id: r.p for r in QUERIES["linear_probe"](spark, SF).collect()}
    assert len(first) > 0 and all({r.image_id: r.p for r in QUERIES["linear_probe"](spark, SF).collect()} == first for _ in range(2))


def test_minimise_many_at_once():
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(4, 7))
    scale = 10 ** rng.uniform(-2, 2, (4, 7))
    f = lambda x: ((scale * (x - centre) ** 2).sum(1), 2 * scale * (x - centre))
    assert np.allclose(optimise.minimise(f, np.zeros((4, 7)), 500, 1e-10), centre, atol=1e-6)


@pytest.mark.parametrize("block", [1_000_000, 7])
def test_percentiles_and_softmax_of_a_hot_key(spark, monkeypatch, block):
    monkeypatch.setattr(metrics, "RANK_BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [(i, 0 if i % 3 else int(i % 5), None if i == 7 else float(rng.integers(0, 9))) for i in range(90)]
    frame = spark.createDataFrame(rows, "id int, k int, s double")
    for r in pooling.percentile_rank(frame, "k", "s").collect():
        mine = [-1.0 if s is None else s for _, k, s in rows if k == r.k]
        s = -1.0 if r.s is None else r.s
        assert r.percentile == round((sum(v < s for v in mine) + (sum(v == s for v in mine) + 1) / 2) * 100 / len(mine), 6)
    for r in pooling.softmax(frame.where("s is not null"), "k", "s", "p").collect():
        assert abs(r.p - np.exp(r.s) / sum(np.exp(s) for _, k, s in rows if k == r.k and s is not None)) < 1e-9
