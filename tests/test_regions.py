"""Regions, masks and stores against plain numpy on small images."""

import numpy as np
import pytest

from tilework.operators import annotations, learning, metrics, rasters, regions, tiles
from tilework.plans.cohort_queries import QUERIES, SQL
from tilework.sources import annotations as readers
from tilework.sources import stores
from tilework.streaming.tiles import counts_by_window

RNG = np.random.default_rng(0)


def images(spark, shapes):
    rows = [(str(i), w, h, 3, bytearray(RNG.integers(0, 256, (h, w, 3)).astype("u1").tobytes())) for i, (h, w) in enumerate(shapes)]
    return rows, spark.createDataFrame(rows, "slide_id string, width int, height int, channels int, data binary")


def test_tiles_are_cut_padded_and_shrunk(spark):
    rows, frame = images(spark, [(20, 30), (9, 9)])
    grid = tiles.tile_grid(frame.select("slide_id", "width", "height"), 4, downsample=2)
    made = regions.extract_tiles(frame, grid, 4, downsample=2, normalize=lambda t: 255 - t).collect()
    assert len(made) == 3 * 4 + 2 * 2
    for r in made:
        _, w, h, _, data = rows[int(r.slide_id)]
        image = np.zeros((h + 8, w + 8, 3), "u2")
        image[:h, :w] = np.frombuffer(bytes(data), "u1").reshape(h, w, 3)
        part = image[r.x : r.x + 8, r.y : r.y + 8]
        want = 255 - (part[::2, ::2] + part[1::2, ::2] + part[::2, 1::2] + part[1::2, 1::2] + 2) // 4
        assert (np.frombuffer(bytes(r.data), "u1").reshape(4, 4, 3) == want).all()
    assert regions.extract_tiles(frame.limit(0), grid, 4).count() == 0 and regions.extract_tiles(frame, grid.limit(0), 4).count() == 0


def test_features_and_thumbnails(spark):
    rows, frame = images(spark, [(8, 8)])
    grid = tiles.tile_grid(frame.select("slide_id", "width", "height"), 4)
    found = {(r.x, r.y): r.features for r in regions.extract_features(frame, grid, 4, "cosine8").collect()}
    image = np.frombuffer(bytes(rows[0][4]), "u1").reshape(8, 8, 3)
    run = learning.ENCODERS["cosine8"]()
    assert all(np.allclose(f, run(image[x : x + 4, y : y + 4].reshape(1, -1).astype("f8"))[0]) for (x, y), f in found.items()) and len(found) == 4
    small = regions.thumbnails(frame, 4).first()
    assert (small.width, small.height) == (4, 4) and np.frombuffer(bytes(small.data), "u1").reshape(4, 4, 3)[0, 0, 0] == (image[:2, :2, 0].astype(int).sum() + 2) // 4


def flooded(mask):
    """The background reached from outside by steps along rows and columns."""
    wide = np.pad(mask, 1)
    out, todo = np.zeros_like(wide), [(0, 0)]
    while todo:
        r, c = todo.pop()
        if 0 <= r < wide.shape[0] and 0 <= c < wide.shape[1] and not wide[r, c] and not out[r, c]:
            out[r, c] = True
            todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    return out[1:-1, 1:-1]


def test_holes_are_filled(spark):
    masks = {1: RNG.random((14, 11)) < 0.6, 2: RNG.random((9, 9)) < 0.5, 3: np.eye(1, dtype=bool)}
    frame = spark.createDataFrame([(s, int(r), int(c), 2) for s, m in masks.items() for r, c in zip(*np.nonzero(m))], "slide_id int, row int, col int, class_id int")
    found = {(r.slide_id, r.row, r.col) for r in rasters.binary_mask(frame, 2).collect()}
    assert found == {(s, int(r), int(c)) for s, m in masks.items() for r, c in zip(*np.nonzero(~flooded(m)))}
    assert rasters.binary_mask(frame, 1).count() == 0


def test_tissue_filter_equals_counting(spark):
    pixels = RNG.random((40, 40)) < 0.3
    mask = spark.createDataFrame([(1, int(r), int(c), 1) for r, c in zip(*np.nonzero(pixels))], "slide_id int, row int, col int, class_id int")
    slide = spark.createDataFrame([(1, 40, 40, 3, 40, 1, 40)], "slide_id int, width int, height int, x_min int, x_max int, y_min int, y_max int")
    for dim, stride in ((8, 8), (8, 6), (6, 9), (5, 2)):
        grid = tiles.tile_grid(slide, dim, stride)
        want = {(x, y, int(pixels[x : x + dim, y : y + dim].sum())) for x in range(3, 40, stride) for y in range(1, 40, stride)}
        assert {(r.x, r.y, r.pixels) for r in tiles.tissue_filter(grid, mask, dim, 1, 0.3, stride).collect()} == {w for w in want if w[2] >= 0.3 * dim * dim}
        assert {(r.x, r.y, r.pixels) for r in tiles.tissue_filter(grid, mask, dim, 1, 0, stride).collect()} == want


def test_snap_dimension(spark):
    from operator import ge, gt, lt

    from pyspark.sql import functions as F

    for name, op in {">": gt, "=>": ge, "<": lt}.items():
        rows = spark.range(1, 60).select("id", tiles.snap_dimension(F.col("id"), 7, 21, name).alias("m"), tiles.snap_dimension(F.col("id"), 7).alias("up")).collect()
        for r in rows:
            allowed = [m for m in range(0, 700, 7) if op(m, 21)]
            assert r.m == min(allowed, key=lambda m: (abs(r.id - m), m)) and r.up == -(-r.id // 7) * 7
    with pytest.raises(ValueError):
        tiles.snap_dimension(F.lit(1), 2, 3, "?")


@pytest.mark.parametrize("block", [4096, 5])
def test_running_sums_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(metrics, "RANK_BLOCK", block)
    scores, labels = RNG.integers(0, 40, 200), RNG.integers(0, 2, 200)
    pairs = [(a > b) + (a == b) / 2 for a in scores[labels == 1] for b in scores[labels == 0]]
    frame = spark.createDataFrame([(float(s), int(y)) for s, y in zip(scores, labels)], "score double, label int")
    assert metrics.binary_auc(frame).first().auc == round(float(np.mean(pairs)), 6)
    rows = [("g", float(t), bool(e), float(r), i) for i, (t, e, r) in enumerate(zip(RNG.integers(0, 30, 120), RNG.integers(0, 2, 120), RNG.random(120)))]
    order = sorted(rows, key=lambda r: (-r[1], not r[2], r[4]))
    hazards = np.cumsum(np.exp([r[3] for r in order]))
    want = np.mean([np.log(h) - r[3] if r[2] else 0.0 for h, r in zip(hazards, order)])
    assert abs(metrics.cox_loss(spark.createDataFrame(rows, "g string, t double, e boolean, r double, i int"), "g", "t", "e", "r", "i").first().loss - want) < 2e-6


def test_store_upsert_and_annotation_sources(spark, tmp_path):
    entry = lambda k, v: (k, [1], "u1", bytearray([v]))
    schema = "key string, shape array<int>, dtype string, data binary"
    stores.write_kv(spark.createDataFrame([entry("a", 1), entry("b", 2)], schema), f"{tmp_path}/kv")
    stores.upsert_kv(spark, spark.createDataFrame([entry("b", 3), entry("c", 4)], schema), f"{tmp_path}/kv", f"{tmp_path}/kv2")
    assert {r.key: r.data[0] for r in stores.read_kv(spark, f"{tmp_path}/kv2").collect()} == {"a": 1, "b": 3, "c": 4}
    (tmp_path / "s1.json").write_text('{"t": {"0": [{"x": 1, "y": 2}, {"x": 3, "y": 4}]}}')
    (tmp_path / "s1.csv").write_text("idx,labels,x,y\n0,t,5,6\n1,t,7,8\n")
    (tmp_path / "s2.xml").write_text('<Annotations><Annotation Name="n"><Regions><Region Id="1"><Vertices><Vertex X="1.5" Y="2.5"/><Vertex X="3" Y="4"/></Vertices></Region></Regions></Annotation></Annotations>')
    both = readers.read_annotations(spark, [f"{tmp_path}/s1.json", f"{tmp_path}/s1.csv"], ["json", "csv"]).collect()
    assert sorted((r.roi_id, r.vertex_id, r.x, r.y) for r in both) == [(0, 0, 1, 2), (0, 1, 3, 4), (1, 0, 5, 6), (1, 1, 7, 8)]
    xml = readers.read_annotations(spark, f"{tmp_path}/s2.xml", "imagej").collect()
    assert [(r.slide_id, r.label, r.x, r.y) for r in xml] == [("s2", "n", 2, 2), ("s2", "n", 3, 4)]
    stores.save_annotations(spark.createDataFrame(both), f"{tmp_path}/out")
    assert spark.read.csv(f"{tmp_path}/out", header=True).columns == ["labels", "x", "y"]
    assert annotations.polygon_centroids(spark.createDataFrame([("s", "l", 0, i, x, y) for i, (x, y) in enumerate([(0, 0), (4, 0), (4, 2), (0, 2)])], "slide_id string, label string, roi_id int, vertex_id int, x int, y int")).first()[3:] == (2.0, 1.0)


def test_windows_as_a_stream(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 10:00:00' as ts, 'a' as label union all select timestamp'2024-01-05 10:00:00', 'b'").write.parquet(f"{tmp_path}/in")
    query = counts_by_window(spark.readStream.schema("ts timestamp, label string").parquet(f"{tmp_path}/in"), "ts", "label").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.label, r.n) for r in spark.table("windows").collect()) == [("a", 1), ("b", 1)]


@pytest.mark.parametrize("name", ["tile_grid_border", "tissue_filter_overlap", "unfold_patches", "fold_patches", "gated_attention", "class_metrics", "split_by_patient", "stitch_canvas_gaps"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("part", "events", "lineitem", "embeddings", "customer", "orders", "documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    want = con.execute(SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(map(str, map(tuple, QUERIES[name](spark, "/root/testdata/sf0.001").select(columns).collect()))) == sorted(map(str, want.fetchall()))
