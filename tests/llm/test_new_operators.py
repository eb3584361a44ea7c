"""Periodic runs, toxicity and whitening against plain versions on small tables."""

import binascii
import hashlib
import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tilework.llm import periodic_runs, toxicity, whitening
from tilework.llm.queries import queries

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, runs string, key string, score string"


def plain_runs(words):
    """All maximal stretches of every period, those with a smaller period left out."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - s >= max(6, 4 * p):
                found.setdefault((s, i + p), p)
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_report(doc_id, text):
    words = (text or "").encode().split()
    h, n = binascii.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + k for s, k, p in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, hashlib.sha256("".join(f"{s},{k},{p}\n" for s, k, p in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def held(rows):
    return sorted(map(tuple, rows), key=str)


def repetitive(rng, n):
    out = []
    while len(out) < n:
        part = rng.choice(list("abc"), int(rng.integers(1, 5))).tolist()
        out += part * int(rng.integers(1, 7))
    return out[:n]


def test_runs_of_signs_equal_plain_ones():
    rng = np.random.default_rng(1)
    for k in range(300):
        docs = [[w.encode() for w in repetitive(rng, int(rng.integers(0, 60)))] for _ in range(int(rng.integers(1, 6)))]
        if k % 3 == 0:
            docs.append(docs[0])
            docs.append([b"x", *docs[0], b"y"])
        if k % 7 == 0:
            docs.append([b"p", b"q", *docs[0] * 5])
        assert periodic_runs._group(docs) == [plain_runs(d) for d in docs]


def test_previous_factors_equal_plain_ones():
    rng = np.random.default_rng(2)
    for _ in range(50):
        t = np.append(rng.integers(0, 3, int(rng.integers(1, 40))), 9)
        order, ranks = periodic_runs.suffix_array(t)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        lcp = np.zeros(len(t), "i8")
        lcp[1:] = periodic_runs.ahead(ranks, order[:-1], order[1:])
        length, place = periodic_runs.previous_factors(order, lcp)
        same = lambda i, j: next((k for k in range(len(t)) if i + k >= len(t) or t[i + k] != t[j + k]), 0)
        assert length == [max((same(i, j) for j in range(i)), default=0) for i in range(len(t))]
        assert all(not n or (place[i] < i and same(i, place[i]) == n) for i, n in enumerate(length))


def test_reports_equal_plain_ones(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [None, "", " \n", "a", "a a a a a a", "la la la la la la\x0bho", "\x85 \x85 \x85 \x85 \x85 \x85 ü ü", "x " * 50, "x " * 50, "日本 go " * 7 + "end"]
    texts += [" ".join(repetitive(rng, int(rng.integers(0, 200)))) for _ in range(120)]
    rows = [(i, t, "r", "k", "s") for i, t in enumerate(texts)] + [(8, texts[8], "", "", ""), (None, "b b b b b b b", "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = held(plain_report(r[0], r[1]) for r in rows)
    assert held(periodic_runs.report(docs, repeat_tails=True).collect()) == want
    monkeypatch.setattr(periodic_runs, "GROUP_WORDS", 100)
    assert held(periodic_runs.report(docs, repeat_tails=True).collect()) == want
    assert periodic_runs.report(docs.limit(0)).count() == 0


def test_a_long_text_of_one_run(spark):
    docs = spark.createDataFrame([(1, "one two three " * 200_000 + "end")], "doc_id long, text string")
    r = periodic_runs.detect(docs).first()
    assert [tuple(x) for x in r.runs] == [(0, 600_000, 3)] and r.collapsed == "one two three end"


def test_runs_of_the_documents(spark):
    rows = duckdb.sql(f"select doc_id, text from read_parquet('{SF}/documents.parquet') where length(text) < 4000").fetchall()
    got = {r.doc_id: tuple(r) for r in queries()["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == 1000
    for i, text in rows:
        assert got[i] == plain_report(i, text)


def plain_whitening(rows):
    """Exact sums by Python's numbers, numpy's eigen-solver."""
    xs = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in xs}), "f8")
    exact = sorted({tuple(x) for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*exact)]
    values, vectors = np.linalg.eigh(np.cov((fit - 1_000_000).T, bias=True).reshape(fit.shape[1], -1))
    return xs, n, sums, values[::-1], vectors[:, ::-1].T


def check_whitening(rows, got, k=16):
    xs, n, sums, values, vectors = plain_whitening(rows)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    k = min(k, len(values))
    assert len(got) == len(xs) * k
    for i, x in xs:
        apart = [n * c - s for c, s in zip(x, sums)]
        for c in range(k):
            r = by[i][c + 1][0]
            assert r.n == n and r.deviation == sum(a * a for a in apart) and abs(r.explained / (values[c] / values.sum()) - 1) < 1e-9
            want = float(np.array(apart) / n @ vectors[c]) / math.sqrt(values[c])
            assert min(abs(r.whitened - want), abs(r.whitened + want)) < 1e-6 and r.identity_error < 1e-9


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=20) * (1 + np.arange(20))).astype("f4").tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(200)]  # a vector that many share
    odd = [(900, None), (901, [*rows[0][1][:19], None]), (902, [*rows[0][1][:19], float("nan")]), (903, [*rows[0][1][:19], float("inf")]), (904, []), (905, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], "vec_id long, embedding array<float>, x string, component int").repartition(7)
    check_whitening(rows, whitening.whiten(frame).collect())
    assert whitening.whiten(frame.limit(0)).count() == 0 and whitening.whiten(frame.where("vec_id between 900 and 904")).count() == 0


def test_whitening_signs_and_merging(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MERGED_AT_ONCE", 2)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=5).astype("f4").tolist()) for i in range(80)]
    frame = spark.createDataFrame([*rows, (None, rows[0][1]), (3, rows[3][1])], "vec_id long, embedding array<float>").repartition(9)
    got = whitening.whiten(frame).collect()
    check_whitening([*rows, (None, rows[0][1]), (3, rows[3][1])], got)
    z = np.array([[r.whitened for r in sorted((r for r in got if r.vec_id == i), key=lambda r: r.component)[:5]] for i in range(80) if i != 3])
    again = {r.component: r.whitened for r in got if r.vec_id is None}
    assert np.allclose(z[0], [again[c] for c in range(1, 6)])


def test_whitening_without_spread(spark):
    one = spark.createDataFrame([(1, [0.5, -0.5]), (2, [0.5, -0.5])], "vec_id long, embedding array<double>")
    rows = whitening.whiten(one).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows] == [(1, 0, None, 0.0, 0.0)] * 4
    line = spark.createDataFrame([(i, [float(i), float(i)]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r.component: r.whitened is None for r in whitening.whiten(line).collect()} == {1: False, 2: True}
    huge = spark.createDataFrame([(1, [1e37, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 5.0])], "vec_id long, embedding array<double>")
    assert {r.deviation is None for r in whitening.whiten(huge).collect()} == {True} and whitening.whiten(huge).count() == 6


def test_qr_equals_numpy():
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 17, 64):
        a = rng.normal(size=(n, n))
        a = a @ a.T if n % 2 else np.diag(np.arange(n) // 2.0) + 0 * a
        values, vectors = whitening.symmetric_eigen(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-10 * max(1, np.abs(a).max()))
        assert np.allclose(vectors @ vectors.T, np.eye(n), atol=1e-12) and np.allclose(vectors @ a @ vectors.T, np.diag(values), atol=1e-10 * max(1, np.abs(a).max()))


def test_whitening_of_the_embeddings(spark):
    rows = duckdb.sql(f"select vec_id, embedding from read_parquet('{SF}/embeddings.parquet')").fetchall()
    check_whitening(rows, queries()["op13_whitening"](spark, SF).collect())


def made_up(rng, n):
    clean = ["sun", "rain", "walk", "house", "river", "green", "slow", "bird", "stone", "light", "paper", "window"]
    rows = []
    for i in range(n):
        text = [" ".join(rng.choice(clean, int(rng.integers(3, 9)))) for _ in range(int(rng.integers(1, 9)))]
        toxic = rng.random() < 0.3
        if toxic:
            k = int(rng.integers(0, len(text)))
            text[k] += " vile" + "".join(rng.choice(list("abcdef"), 3))
        rows.append((i, ". ".join(text) + ".", int(toxic)))
    return rows


def test_toxicity_finds_sentences(spark):
    rows = made_up(np.random.default_rng(8), 900)
    docs = spark.createDataFrame([(i, t, "q", 1.0) for i, t, _ in rows] + [(2000, None, "", 0.0), (2001, "", "", 0.0), (2002, " .!\n", "", 0.0), (None, rows[0][1], "", 0.0), (1, rows[1][1], "", 0.0)], "doc_id long, text string, sentences string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(5000, 1, 1), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == docs.count()
    truth, texts = {i: y for i, _, y in rows}, {i: t for i, t, _ in rows}
    for r in got:
        assert r.held_out == (binascii.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.doc_id is not None and r.doc_id >= 2000:
            assert r.score == 0.0 and r.sentences == []
    known = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in known]) > 0.97
    for r in known:
        if r.predicted and truth[r.doc_id]:
            assert any("vile" in texts[r.doc_id][s.start : s.end] for s in r.sentences)


def test_toxicity_never_learns_from_held_out_labels(spark):
    rows = made_up(np.random.default_rng(9), 300)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    out = lambda i: binascii.crc32(str(i).encode()) % 5 == 0
    a = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    b = spark.createDataFrame([(i, 1 - y if out(i) else y) for i, _, y in rows], "doc_id long, toxic int")
    assert np.array_equal(toxicity.fit(docs, a), toxicity.fit(docs, b))


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, "others")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in toxicity.classify(docs, none).collect())
    assert toxicity.classify(docs.limit(0), none).count() == 0


def plain_noisy_or(text, weights):
    chance = 1.0
    for _, _, words in toxicity.sentences(text or ""):
        z = weights[-1] + sum(float(weights[toxicity.features(w)].sum()) for w in words)
        chance *= 1 - 1 / (1 + math.exp(-z))
    return 1 - chance


@pytest.fixture(scope="module")
def judged(spark):
    return {r.doc_id: r for r in queries()["op11_toxicity"](spark, SF).collect()}


def test_toxicity_of_held_out_documents(judged):
    truth = dict(duckdb.sql(f"select doc_id, toxic from read_parquet('{SF}/labels.parquet')").fetchall())
    known = [(r.predicted, truth[i]) for i, r in judged.items() if r.held_out and i in truth]
    assert len(judged) == 1000 and np.mean([a == b for a, b in known]) > 0.9


def test_scores_are_noisy_or(spark):
    rng = np.random.default_rng(10)
    weights = np.append(rng.normal(size=toxicity.BUCKETS), -3.0)
    rows = made_up(rng, 40) + [(50, None, 0), (51, "Übel! 日本。ok?", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, weights).collect()}
    assert all(abs(got[i] - plain_noisy_or(t, weights)) < 1e-9 for i, t, _ in rows)
