"""The pipeline, and the estimation behind its first stage, against plain versions."""

import math
from collections import defaultdict

import numpy as np
from test_operators import base_spans, crc, ids_of
from test_simhash_pairs import brute

import corpus_pipeline
from tilework.llm import quality, simhash_pairs


def plain_em(rows, rounds=500):
    """The posterior of each distinct row of votes: expectation-maximisation over single rows, with the same start and priors."""
    n_rules = len(rows[0])
    start = {0: 0.95, 1: 0.4}
    posterior = [start.get(sum(v < 0 for v in r), 0.05) for r in rows]
    for _ in range(rounds):
        weight = [sum(1 - p for p in posterior), sum(posterior)]
        share = (weight[1] + quality.PRIOR_GOOD * quality.PRIOR_WEIGHT) / (len(rows) + quality.PRIOR_WEIGHT)
        share = min(max(share, 0.01), 0.99)
        rates = [[[0.0] * 3 for _ in range(2)] for _ in range(n_rules)]
        for k in range(n_rules):
            for c in range(2):
                for v in range(3):
                    rates[k][c][v] = quality.PRIOR_VOTES[c][v] + sum((p if c else 1 - p) for r, p in zip(rows, posterior) if r[k] == v - 1)
                whole = sum(rates[k][c])
                rates[k][c] = [x / whole for x in rates[k][c]]
        posterior = []
        for r in rows:
            odds = math.log(share / (1 - share)) + sum(math.log(rates[k][1][v + 1] / rates[k][0][v + 1]) for k, v in enumerate(r))
            posterior.append(1 / (1 + math.exp(-odds)))
    return dict(zip(map(tuple, rows), posterior))


def test_estimate_equals_a_plain_one():
    rng = np.random.default_rng(7)
    good = rng.random(300) < 0.8
    votes = np.stack([np.where(rng.random(300) < 0.5, np.where((rng.random(300) < 0.85) == good, 1, -1), 0) for _ in range(4)], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, _, _ = quality.estimate(patterns, counts.astype(float))
    want = plain_em(votes.tolist())
    assert max(abs(p - want[tuple(v)]) for v, p in zip(patterns.tolist(), posterior.tolist())) < 1e-4


def plain_quality(texts):
    seen = [quality.signals(t or "") for t in texts]
    votes = [tuple(rule(s) for rule in quality.RULES.values()) for s in seen]
    passed = [v for v, s in zip(votes, seen) if not s.base_failed]
    good = plain_em(passed, 120) if passed else {}
    return [not s.base_failed and good[v] >= quality.KEEP_AT for v, s in zip(votes, seen)]


def plain_mask(text):
    spans = sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in base_spans(text)))
    out, at = [], 0
    for start, back, kind in spans:
        if start >= at:
            out.append(text[at:start] + f"<{kind.upper()}>")
        at = max(at, -back)
    return "".join(out) + text[at:]


def test_pipeline_equals_a_plain_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(simhash_pairs, "RECALL", 0.9999)
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in base.collect()]
    long = [r for r in rows if r[1] and len(r[1].split()) > 120][:6]
    rows += [(9_000 + i, r[1].replace(" a ", " the ", 1) + " call +49 (30) 1234567 now", *r[2:]) for i, r in enumerate(long)]
    rows += [(9_100, None, None, None, None), (9_101, "", "en", "s", 0), (None, long[0][1], "en", "s", 5), rows[0]]
    spark.createDataFrame(rows, base.schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    made = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [(i, t, "") for (i, t, *_), ok in zip(rows, plain_quality([r[1] for r in rows])) if ok]
    left = [None if last else i for last, i in brute(kept)]
    texts = {}
    for i, t, _ in kept:
        texts.setdefault(i, t)
    want = {i: ids_of(plain_mask(texts[i])) + [2] for i in left}
    found, bins = defaultdict(int), defaultdict(list)
    for r in made:
        assert r.ids_crc32 == crc(want[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(want[r.doc_id])
        found[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert found == {i: len(x) for i, x in want.items()} and len(left) > 50
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
