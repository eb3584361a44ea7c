"""Layers, attention and two-level embeddings against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilework.operators import attention, learning

RNG = np.random.default_rng(31)


@pytest.fixture(scope="module")
def tiles(spark):
    x = RNG.normal(size=(60, 6))
    rows = [(k, i, bool(i % 4 == 3), x[k * 20 + i].tolist()) for k in range(3) for i in range(20 if k else 9)]
    return x, spark.createDataFrame(rows, "slide int, i int, pad boolean, v array<double>").repartition(4)


def rows_softmax(x):
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def test_layers_with_bias_and_mask(tiles):
    x, frame = tiles
    w1, b1, w2 = RNG.normal(size=(4, 6)), RNG.normal(size=4), RNG.normal(size=(2, 4))
    for name, f in (("relu", lambda a: np.maximum(a, 0)), ("tanh", np.tanh), ("gelu", lambda a: np.array([[t / 2 * (1 + math.erf(t / math.sqrt(2))) for t in r] for r in a]))):
        want = f(x @ w1.T + b1) @ w2.T
        for r in attention.score_layers(frame, ["slide", "i"], "v", [(w1, b1), (w2, None)], name, mask="pad").collect():
            assert r.scores == [float("-inf")] * 2 if r.i % 4 == 3 else np.allclose(r.scores, want[r.slide * 20 + r.i])


def test_weights_out_of_a_table(spark):
    w = RNG.normal(size=(3, 5))
    w[0, 0] = 0
    table = spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(w) if v], "row int, col int, value double")
    assert np.array_equal(attention.matrix_of(table), w) and attention.matrix_of(table.limit(0)).shape == (0, 0)


def test_class_attention_of_several_heads(tiles):
    x, frame = tiles
    q, k = RNG.normal(size=(6, 6)), RNG.normal(size=(6, 6))
    got = {(r.slide, r.i, r.head): r.attention for r in attention.class_attention(frame, "slide", "i", "v", q, k, 3).collect()}
    assert len(got) == (8 + 19 + 19) * 3
    for s, n in ((0, 9), (1, 20), (2, 20)):
        part = x[s * 20 : s * 20 + n]
        for h in range(3):
            at = slice(2 * h, 2 * h + 2)
            want = rows_softmax((part[:1] @ q.T)[:, at] @ (part @ k.T)[:, at].T / math.sqrt(2))[0]
            assert np.allclose([got[s, i, h] for i in range(1, n)], want[1:])
    lines = attention.attention_lines(attention.class_attention(frame, "slide", "i", "v", q, k, 3).where("slide = 0 and head = 1"), "slide", "i", 3, 2).collect()
    grid = np.array([got[0, i, 1] if i < 9 else 0.0 for i in range(1, 10)]).reshape(3, 3)
    assert np.allclose([r.line for r in sorted(lines, key=lambda r: r.row)], grid.repeat(2, 0).repeat(2, 1))


def test_two_levels(tiles):
    x, frame = tiles
    regions = frame.where("not (slide = 1 and i = 6)").withColumn("region", F.floor(F.col("i") / 5).cast("int")).withColumn("place", F.col("i") % 5)
    run = learning.ENCODERS["cosine8"]()
    got = {(r.slide, r.region): r for r in attention.two_level(regions, "slide", "region", "place", "v", "cosine8", "cosine8", 5, 8).collect()}
    assert len(got) == 2 + 4 + 4
    for (s, g), r in got.items():
        have = [i for i in range(g * 5, min(g * 5 + 5, 20 if s else 9)) if (s, i) != (1, 6)]
        first, grid = run(x[[s * 20 + i for i in have]]), np.zeros((5, 8))
        grid[[i % 5 for i in have]] = first
        assert np.allclose(r["mean"], first.mean(0)) and np.allclose(r.whole, run(grid.reshape(1, -1))[0]) and r.features == r["mean"] + r.whole


def test_nystroem_with_all_tiles_is_full_attention(tiles, monkeypatch):
    monkeypatch.setattr(attention, "CHUNK", 7)
    x, frame = tiles
    got = {(r.slide, r.i): r.attended for r in attention.nystroem_attention(frame, "slide", "i", "v", 64, 30).collect()}
    assert len(got) == 49
    for s, n in ((0, 9), (1, 20)):
        part = x[s * 20 : s * 20 + n]
        want = rows_softmax(part @ part.T / math.sqrt(6)) @ part
        assert np.allclose([got[s, i] for i in range(n)], want, atol=1e-4)


def test_nystroem_by_few_landmarks(tiles):
    x, frame = tiles
    got = {(r.slide, r.i): r.attended for r in attention.nystroem_attention(frame, "slide", "i", "v", 4).collect()}
    part = x[20:40]
    marks = np.stack([part[[i for i in range(20) if i * 4 // 20 == m]].mean(0) for m in range(4)])
    a, b, c = (rows_softmax(p @ q.T / math.sqrt(6)) for p, q in ((part, marks), (marks, marks), (marks, part)))
    assert np.allclose([got[1, i] for i in range(20)], a @ attention.pseudo_inverse(b) @ c @ part)
    assert np.allclose(attention.pseudo_inverse(b, 30) @ b, np.eye(4), atol=1e-6)
