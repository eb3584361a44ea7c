"""Queries over whole tables, and concordance without pairs."""

import duckdb
import numpy as np
import pytest

from tilework.operators import metrics
from tilework.plans.image_queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["cindex", "cindex_all", "missing_patches_all", "outer_join_chain_all", "label_right_join_all"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "events", "lineitem", "embeddings", "customer", "orders", "documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(map(str, map(tuple, QUERIES[name](spark, SF).select(columns).collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("block", [4096, 3])
def test_cindex_makes_no_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(metrics, "RANK_BLOCK", block)
    rng = np.random.default_rng(block)
    rows = [(float(t) if t else None, [True, False, None][e], float(r) if r else None) for t, e, r in zip(rng.integers(0, 30, 150).tolist(), rng.integers(0, 3, 150).tolist(), rng.integers(0, 20, 150).tolist())]
    won = n = 0
    for t, e, r in rows:
        for u, f, q in rows:
            if e and t is not None and u is not None and (t < u or (t == u and f is False)):
                n += 1
                won += 0 if r is None or q is None else (r > q) + (r == q) / 2
    found = metrics.cindex(spark.createDataFrame(rows, "t double, e boolean, r double"), "t", "e", "r")
    assert tuple(found.first()) == (round(won / n, 6), n)
    if block == 3:  # with one block only, that block's row is joined without a key
        assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert tuple(metrics.cindex(spark.createDataFrame([], "t double, e boolean, r double"), "t", "e", "r").first()) == (None, 0)
