import duckdb
import pytest

from tilework.operators import annotations, cohorts, metrics, tiles
from tilework.plans.queries import QUERIES, SQL
from tilework.sources.annotations import read_annotations

SF = "/root/testdata/sf0.001"


def same(x):
    if isinstance(x, float):
        return f"{x:.5g}"
    return str(x)


@pytest.mark.parametrize("name", ["tile_grid", "annotation_bbox", "polygon_measures", "tissue_filter", "binary_auc", "cox_loss", "mean_pool", "stratified_group_kfold", "outer_join_chain"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "events", "lineitem", "embeddings", "customer", "orders", "documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = QUERIES[name](spark, SF)
    want = con.execute(SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert sorted(tuple(map(same, r)) for r in found.select(columns).collect()) == sorted(tuple(map(same, r)) for r in want.fetchall())


def test_empty_slide_has_no_tiles(spark):
    slides = spark.createDataFrame([(1, 0, 0), (2, 600, 300), (3, 100, 100)], "slide_id long, width int, height int")
    assert sorted(map(tuple, tiles.tile_grid(slides, 256).collect())) == [(2, 0, 0), (2, 0, 256), (2, 0, 512), (2, 256, 0), (2, 256, 256), (2, 256, 512), (3, 0, 0)]
    assert sorted(map(tuple, tiles.tile_grid(slides, 256, drop_edges=True).collect())) == [(2, 0, 0), (2, 0, 256)]


def test_square_measures_and_box(spark):
    v = spark.createDataFrame([(1, "a", 0, i, x, y) for i, (x, y) in enumerate([(0, 0), (4, 0), (4, 4), (0, 4)])], "slide_id int, label string, roi_id int, vertex_id int, x int, y int")
    assert tuple(annotations.polygon_measures(v).first())[3:] == (4, 16.0, 16.0)
    assert tuple(annotations.bbox(v, 3, 1).first())[1:] == (-1, 3, -1, 3)


def test_readers(spark, tmp_path):
    (tmp_path / "s1.json").write_text('{"tumour": {"r1": [{"x": 1, "y": 2}, {"x": 3, "y": 4}], "r2": [{"x": 5, "y": 6}]}}')
    assert sorted(map(tuple, read_annotations(spark, str(tmp_path / "s1.json")).collect())) == [("s1", "tumour", 0, 0, 1, 2), ("s1", "tumour", 0, 1, 3, 4), ("s1", "tumour", 1, 0, 5, 6)]
    (tmp_path / "s2.csv").write_text(",labels,x,y\n0,a,1,2\n1,None,3,4\n2,a,5,6\n")
    assert sorted(map(tuple, read_annotations(spark, str(tmp_path / "s2.csv"), "csv").collect())) == [("s2", "a", 0, 0, 1, 2), ("s2", "a", 0, 1, 5, 6), ("s2", "undefined", 0, 0, 3, 4)]
    (tmp_path / "s3.geojson").write_text('[{"properties":{"classification":{"name":"t"}},"geometry":{"type":"Polygon","coordinates":[[[1.9,2.1],[3,4]],[[5,6]]]}},{"properties":{"classification":{"name":"t"}},"geometry":{"type":"LineString","coordinates":[[7,8]]}}]')
    assert sorted(map(tuple, read_annotations(spark, str(tmp_path / "s3.geojson"), "qupath").collect())) == [("s3", "t", 0, 0, 1, 2), ("s3", "t", 0, 1, 3, 4), ("s3", "t", 1, 0, 5, 6), ("s3", "t", 2, 0, 7, 8)]
    (tmp_path / "s4.xml").write_text('<A><Annotations><Annotation Name="n" PartOfGroup="g"><Coordinates><Coordinate Order="1" X="3.5" Y="1"/><Coordinate Order="0" X="2.5" Y="1"/></Coordinates></Annotation></Annotations></A>')
    assert sorted(map(tuple, read_annotations(spark, str(tmp_path / "s4.xml"), "asap").collect())) == [("s4", "g", 0, 0, 2, 1), ("s4", "g", 0, 1, 4, 1)]


def test_auc_of_one_class_is_null_and_ties_count_half(spark):
    assert metrics.binary_auc(spark.createDataFrame([(1.0, 1), (2.0, 1)], "score double, label int")).first().auc is None
    assert metrics.binary_auc(spark.createDataFrame([(1.0, 1), (1.0, 0)], "score double, label int")).first().auc == 0.5


def test_group_folds_keep_groups_together(spark):
    rows = spark.range(200).selectExpr("id", "id % 23 as g")
    assert cohorts.group_kfold(rows, "g", 5).groupBy("g").agg({"fold": "approx_count_distinct"}).toPandas().iloc[:, 1].max() == 1
