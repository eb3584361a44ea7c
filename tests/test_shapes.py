"""Contours, distances, peaks and floods against plain walks on small masks."""

import heapq

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tilework.operators import blocks, rasters, shapes, tables
from tilework.plans.cohort_queries import QUERIES, SQL

RNG = np.random.default_rng(4)


def frame(spark, masks):
    return spark.createDataFrame([(s, int(r), int(c)) for s, m in masks.items() for r, c in zip(*np.nonzero(m))], "slide_id int, row int, col int")


def disks(h, w, *some):
    y, x = np.mgrid[:h, :w]
    return np.logical_or.reduce([(y - a) ** 2 + (x - b) ** 2 <= r * r for a, b, r in some])


def inside(rings, y, x):
    """Even-odd rule for a pixel's centre."""
    hits = 0
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            hits += (y0 > y + 0.5) != (y1 > y + 0.5) and x0 > x + 0.5
    return hits % 2 == 1


def test_rings_enclose_their_pixels(spark):
    masks = {1: RNG.random((12, 15)) < 0.5, 2: RNG.random((9, 9)) < 0.7, 3: np.ones((1, 1), bool), 4: disks(20, 20, (10, 10, 8)) & ~disks(20, 20, (10, 10, 4)), 5: np.eye(4, dtype=bool)}
    found = rasters.components(frame(spark, masks))
    vertices = shapes.contours(found)
    rings = {}
    for v in sorted(vertices.collect(), key=lambda v: v.vertex_id):
        rings.setdefault((v.slide_id, v.component, v.roi_id, v.hole), []).append((v.x, v.y))
    for s, m in masks.items():
        mine = [r for k, r in rings.items() if k[0] == s]
        assert all(inside(mine, y, x) == bool(m[y, x]) for y in range(m.shape[0]) for x in range(m.shape[1]))
    for ring in rings.values():  # corners only, turn by turn
        assert all((a == c) != (b == d) for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]))
        assert all((p[0] == q[0]) != (q[0] == r[0]) for p, q, r in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2]))
    measured = shapes.contour_measures(vertices).collect()
    areas = {(r.slide_id, r.component): r.n for r in found.groupBy("slide_id", "component").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n")).collect()}
    assert {(r.slide_id, r.component): r.area for r in measured} == areas
    assert next((r.rings, r.holes) for r in measured if r.slide_id == 4) == (2, 1) and next(r.rings for r in measured if r.slide_id == 5) == 1
    assert shapes.contours(found.limit(0)).count() == 0


def brute_squares(m):
    wide = np.pad(m, 1)
    off = np.argwhere(~wide)
    return {(r - 1, c - 1): int(((off - (r, c)) ** 2).sum(1).min()) for r, c in np.argwhere(wide)}


def brute_peaks(d2, apart):
    rank = {p: (d, -p[0], -p[1]) for p, d in d2.items()}
    return {p for p in d2 if not any(rank[q] > rank[p] and max(abs(q[0] - p[0]), abs(q[1] - p[1])) <= apart for q in d2)}


def brute_flood(d2, tops):
    rank = {p: (d, -p[0], -p[1]) for p, d in d2.items()}
    label, heap = {p: p for p in tops}, []

    def push(p):
        for q in ((p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)):
            if q in d2 and q not in label:
                late, early = sorted((rank[p], rank[q]))
                heapq.heappush(heap, (tuple(-x for x in late), tuple(-x for x in early), p, q))

    for p in tops:
        push(p)
    while heap:
        _, _, p, q = heapq.heappop(heap)
        if q not in label:
            label[q] = label[p]
            push(q)
    return label


def test_distances_peaks_and_floods_equal_plain_ones(spark):
    masks = {1: disks(30, 44, (14, 12, 10), (15, 29, 11)), 2: RNG.random((18, 18)) < 0.75, 3: np.ones((5, 30), bool), 4: np.ones((1, 1), bool)}
    mask = frame(spark, masks)
    dist = shapes.distances(mask, ["slide_id"])
    got = {}
    for r in dist.collect():
        got.setdefault(r.slide_id, {})[r.row, r.col] = r.d2
    tops, labels = {}, {}
    for r in shapes.peaks(dist, ["slide_id"], 4).collect():
        tops.setdefault(r.slide_id, set()).add((r.row, r.col))
    for r in shapes.flood(dist, shapes.peaks(dist, ["slide_id"], 4), ["slide_id"]).collect():
        if r.peak_row is not None:
            labels.setdefault(r.slide_id, {})[r.row, r.col] = (r.peak_row, r.peak_col)
    for s, m in masks.items():
        want = brute_squares(m)
        assert got[s] == want and tops[s] == brute_peaks(want, 4) and labels[s] == brute_flood(want, tops[s])


def test_touching_disks_become_two(spark):
    parts = shapes.split_touching(rasters.components(frame(spark, {7: disks(40, 60, (18, 16, 14), (20, 42, 14))})), 10).collect()
    tops = {(r.peak_row, r.peak_col) for r in parts}
    assert len(tops) == 2 and all(min(tops, key=lambda t: (r.row - t[0]) ** 2 + (r.col - t[1]) ** 2) == (r.peak_row, r.peak_col) for r in parts if abs(r.col - 29) > 2)


def test_contour_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{sf}/lineitem.parquet')")
    for t in ("part", "events", "embeddings", "customer", "orders", "documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.execute(SQL["contours"])
    columns = [x[0] for x in want.description]
    assert sorted(map(tuple, QUERIES["contours"](spark, sf).select(columns).collect())) == sorted(want.fetchall())
    assert QUERIES["split_shapes"](spark, sf).count() > 0


@pytest.mark.parametrize("side", [4, 7])
def test_rings_across_blocks_are_those_of_one_block(spark, monkeypatch, side):
    masks = {1: RNG.random((12, 15)) < 0.5, 2: RNG.random((13, 9)) < 0.7, 4: disks(20, 20, (10, 10, 8)) & ~disks(20, 20, (10, 10, 4)), 5: np.eye(6, dtype=bool), 6: RNG.random((8, 8)) < 0.2}
    found = tables.written(rasters.components(frame(spark, masks)))
    want = sorted(map(tuple, shapes.contours(found).collect()))
    monkeypatch.setattr(blocks, "SIDE", side)
    assert sorted(map(tuple, shapes.contours(found).collect())) == want and len(want) > 100


def test_rings_within_a_block_take_no_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(shapes, "written", lambda df: made.append(1) or tables.written(df))
    assert shapes.contours(rasters.components(frame(spark, {1: disks(40, 40, (20, 20, 17))}))).count() > 0 and len(made) == 1


@pytest.mark.parametrize("side", [5, 512])
def test_floods_across_blocks_equal_plain_ones(spark, monkeypatch, side):
    monkeypatch.setattr(blocks, "SIDE", side)
    masks = {1: disks(22, 34, (10, 9, 8), (11, 23, 9)), 2: RNG.random((18, 18)) < 0.75, 3: np.ones((4, 21), bool), 4: np.ones((1, 1), bool)}
    dist = tables.written(shapes.distances(frame(spark, masks), ["slide_id"]))
    want, tops = {}, tables.written(shapes.peaks(dist, ["slide_id"], 4).where("slide_id <> 4"))
    for s, m in masks.items():
        found = brute_squares(m)
        want |= {(s, *p): q for p, q in brute_flood(found, brute_peaks(found, 4) if s != 4 else ()).items()}
    made = []
    monkeypatch.setattr(shapes, "written", lambda df: made.append(1) or tables.written(df))
    got = shapes.flood(dist, tops, ["slide_id"]).collect()
    assert {(r.slide_id, r.row, r.col): (r.peak_row, r.peak_col) for r in got if r.peak_row is not None} == want and len(got) == sum(m.sum() for m in masks.values())
    made.clear()
    assert shapes.flood(dist.where("slide_id = 1"), tops, ["slide_id"]).count() == masks[1].sum() and (side == 5 or len(made) == 1)
