import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tilework.operators import blocks, learning, rasters, tables
from tilework.plans.image_queries import QUERIES, SQL
from tilework.plans.cohort_queries import QUERIES as ALL
from tilework.sources import stores
from tilework.streaming.tiles import append_new

SF = "/root/testdata/sf0.001"


def same(x):
    return f"{x:.4g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", ["missing_patches", "feature_lookup", "center_crop", "pad_mask", "ce_loss", "experiment_hash", "event_windows", "raster_mask", "tissue_mask", "local_entropy", "stitch_canvas", "encode_tiles", "hier_embed"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "events", "lineitem", "embeddings", "customer", "documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found, want = QUERIES[name](spark, SF), con.execute(SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert sorted(tuple(map(same, r)) for r in found.select(columns).collect()) == sorted(tuple(map(same, r)) for r in want.fetchall())


def test_components_equal_a_flood(spark):
    rng = np.random.default_rng(3)
    cells = {(s, int(r), int(c)) for s in (1, 2) for r, c in rng.integers(0, 14, (70, 2))} | {(3, 0, i) for i in range(9)}
    rows = spark.createDataFrame([*cells, next(iter(cells))], "slide_id int, row int, col int")
    seen, want = set(), []
    for start in sorted(cells):
        if start in seen:
            continue
        todo, got = [start], {start}
        while todo:
            s, r, c = todo.pop()
            for n in [(s, r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if n in cells and n not in got:
                    got.add(n)
                    todo.append(n)
        seen |= got
        want.append((*start, len(got), min(r for _, r, _ in got), max(r for _, r, _ in got), min(c for _, _, c in got), max(c for _, _, c in got)))
    found = rasters.component_boxes(rasters.components(rows)).select("slide_id", "component.row", "component.lo", "area", "row_min", "row_max", "col_min", "col_max")
    assert sorted(map(tuple, found.collect())) == sorted(want)
    top = rasters.component_boxes(rasters.components(rows), largest=1)
    assert {r.slide_id: r.area for r in top.collect()} == {s: max(w[3] for w in want if w[0] == s) for s in (1, 2, 3)}


def test_hull_of_a_square_with_a_hole(spark):
    cells = [(1, r, c) for r in range(5) for c in range(5) if (r, c) != (2, 2)]
    v = rasters.hulls(rasters.components(spark.createDataFrame(cells, "slide_id int, row int, col int")))
    assert sorted((r.x, r.y) for r in v.collect()) == [(0, 0), (0, 4), (4, 0), (4, 4)]


def test_overlap_of_one_label_is_a_hole_and_later_class_wins(spark):
    def square(label, roi, a, b):
        return [("s", label, roi, i, x, y) for i, (x, y) in enumerate([(a, a), (b, a), (b, b), (a, b)])]

    v = spark.createDataFrame(square("a", 0, 0, 9) + square("a", 1, 3, 6) + square("b", 0, 0, 2), "slide_id string, label string, roi_id int, vertex_id int, x int, y int")
    key = spark.createDataFrame([("a", 1), ("b", 2)], "label string, class_id int")
    got = {(r.row, r.col): r.class_id for r in rasters.paint(rasters.fill_polygons(v), key).collect()}
    assert (4, 4) not in got and (4, 5) not in got and got[4, 2] == 1 and got[4, 8] == 1
    assert got[0, 0] == 2 and got[1, 2] == 2 and got[1, 3] == 1 and (9, 1) not in got


def test_pca_and_probe(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    rows = spark.createDataFrame([(i, [float(v) for v in r], int(r[0] > 0)) for i, r in enumerate(x)] + [(300, [0.0] * 5, 0)], "id int, v array<double>, y int")
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(learning.principal_components(rows, "v", 2).explainedVariance.toArray(), values[:2] / values.sum(), atol=1e-6)
    p = learning.linear_probe(rows, rows, "id", "v", "y", 0.5, 2)
    assert p.where((F.col("p") > 0.5).cast("int") == F.col("label")).count() > 280
    cv = learning.nested_cv(rows, "id", "v", "y", [0.01, 10.0], 2, 2).collect()
    assert len(cv) == 2 and min(r.auc for r in cv) > 0.95


def test_stores(spark, tmp_path):
    kv = spark.createDataFrame([("1_2", [2, 2], "uint8", bytearray(b"abcd")), ("3_4", [1], "uint8", bytearray(b"x"))], "key string, shape array<int>, dtype string, data binary")
    stores.write_kv(kv, f"{tmp_path}/kv", per_file=1)
    store = stores.read_kv(spark, f"{tmp_path}/kv")
    assert store.count() == 2 and bytes(stores.get(store, "1_2").first().data) == b"abcd" and stores.get(store, "no").count() == 0
    rows = spark.createDataFrame([(1, 0.5), (1, 0.7), (2, 0.1)], "slide_id int, f double")
    assert {r.slide_id for r in stores.write_features(rows.where("slide_id = 1"), f"{tmp_path}/f").collect()} == {1}
    assert {r.slide_id for r in stores.write_features(rows, f"{tmp_path}/f").collect()} == {2}
    assert spark.read.parquet(f"{tmp_path}/f").count() == 3
    stores.write_shards(kv, f"{tmp_path}/shards", 2, stores.split_of(F.col("key"), ["1_"], ["3_"]))
    assert {(r.key, r.split) for r in spark.read.parquet(f"{tmp_path}/shards").collect()} == {("1_2", "valid"), ("3_4", "test")}


def test_pngs_are_read_back(spark, tmp_path):
    data = bytes(range(12))
    tiles = spark.createDataFrame([("s", 4, 8, 2, 2, bytearray(data))], "slide_id string, x int, y int, width int, height int, data binary")
    path = stores.write_pngs(tiles, str(tmp_path)).first().path
    assert path.endswith("s/8_4.png") and zlib.crc32(open(path, "rb").read()[12:29]) == int.from_bytes(open(path, "rb").read()[29:33], "big")
    assert tuple(stores.list_patches(spark, str(tmp_path)).first())[1:] == ("s", 4, 8)
    back = stores.read_tiles(spark, str(tmp_path)).first()
    assert (back.width, back.height, back.channels) == (2, 2, 3) and bytes(back.data) == bytes(data[i + 2 - j] for i in (0, 3, 6, 9) for j in range(3))


def test_clinical_readers(spark, tmp_path):
    (tmp_path / "msi.csv").write_text("p1,MSI-H\np2,Indeterminate\np3,MSS\np4,\n")
    assert sorted(map(tuple, stores.read_msi(spark, str(tmp_path / "msi.csv")).collect())) == [("p1", 1.0), ("p3", 0.0), ("p4", None)]
    (tmp_path / "os.csv").write_text("bcr_patient_barcode,OS,OS.time,PFI,PFI.time\nT-A1-x,1,30,0,20\nT-B2-y,0,[Not Available],1,5\n")
    assert sorted(map(tuple, stores.read_survival(spark, str(tmp_path / "os.csv")).collect())) == [("T-A1-x", "A1", 30.0, -20.0), ("T-B2-y", "B2", None, 5.0)]


def test_stream_appends_each_file_once(spark, tmp_path):
    for _ in range(2):
        spark.range(3).write.mode("append").parquet(f"{tmp_path}/in")
        append_new(spark, f"{tmp_path}/in", "id long", f"{tmp_path}/out", f"{tmp_path}/state", lambda df: df.where("id > 0")).awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def plain_components(cells, touch):
    """(slide, row, col) to the first pixel of what it is connected with; touch 0 leaves corners out."""
    seen = {}
    for start in sorted(cells):
        todo = [start] if start not in seen else []
        while todo:
            s, r, c = p = todo.pop()
            if p in cells and p not in seen:
                seen[p] = start
                todo += [(s, r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if touch or not (a and b)]
    return seen


@pytest.mark.parametrize(("side", "touch"), [(4, 1), (4, 0), (5, 1), (512, 1)])
def test_components_across_blocks(spark, monkeypatch, side, touch):
    monkeypatch.setattr(blocks, "SIDE", side)
    rng = np.random.default_rng(8)
    cells = {(s, int(r) - 6, int(c) - 6) for s, share in ((1, 0.3), (2, 0.6)) for r, c in np.argwhere(rng.random((17, 19)) < share)} | {(3, -7, c) for c in range(-9, 12)} | {(4, i, i) for i in range(-5, 9)}
    found = rasters.run_components(rasters.runs_of(spark.createDataFrame([*cells], "slide_id int, row int, col int")), touch).collect()
    got = {(r.slide_id, r.row, c): tuple(r.component) for r in found for c in range(r.lo, r.hi + 1)}
    assert got == plain_components(cells, touch) and sum(r.hi - r.lo + 1 for r in found) == len(cells)


def test_components_of_small_masks_take_no_rounds(spark, monkeypatch):
    """Masks within a block take as many jobs whatever they hold (before: some more for each doubling of a path)."""
    def written_tables(n):
        made = []
        monkeypatch.setattr(rasters, "written", lambda df: made.append(1) or tables.written(df))
        snake = [(1, r, c) for r in range(0, 2 * n, 2) for c in range(n)] + [(1, r, (r // 2 % 2) * (n - 1)) for r in range(1, 2 * n - 1, 2)]
        assert rasters.component_boxes(rasters.components(spark.createDataFrame(snake, "slide_id int, row int, col int"))).count() == 1
        return len(made)

    assert written_tables(3) == written_tables(20) == 2


@pytest.mark.parametrize("name", ["mask_polygons", "largest_components", "filled_masks"])
def test_masks_within_a_block_take_two_tables(spark, monkeypatch, name):
    made = []
    monkeypatch.setattr(rasters, "written", lambda df: made.append(1) or tables.written(df))
    assert ALL[name](spark, SF).count() > 0 and len(made) == 2


def test_hulls_equal_plain_ones(spark):
    rng = np.random.default_rng(12)
    cells = {(int(s), int(r), int(c)) for s, r, c in zip(rng.integers(0, 3, 150), rng.integers(-7, 9, 150), rng.integers(-9, 8, 150))}
    want = {}
    for p, first in plain_components(cells, 1).items():
        want.setdefault((first[0], f"{first[1]}_{first[2]}"), []).append(p)
    got = {}
    for v in sorted(rasters.hulls(rasters.components(spark.createDataFrame([*cells], "slide_id int, row int, col int"))).collect(), key=lambda v: v.vertex_id):
        got.setdefault((v.slide_id, v.roi_id), []).append((v.x, v.y))
    assert got == {k: rasters._hull([p[2] for p in some], [p[1] for p in some]) for k, some in want.items()}
