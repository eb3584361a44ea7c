import duckdb
import pytest

from tilework.plans.file_queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["array_rows", "record_shards", "slide_pyramids", "class_attention", "two_level_embedding", "masked_scores", "softmax", "attention_rank", "region_pixels", "tile_masks", "folds_disjoint", "cohort_union_dropna"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "events", "lineitem", "embeddings", "customer", "orders", "documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(SQL[name])
    columns = [x[0] for x in want.description]
    same = lambda x: f"{x:.5g}" if isinstance(x, float) else str(x)
    found = QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(tuple(map(same, r)) for r in found.select(columns).collect()) == sorted(tuple(map(same, r)) for r in want.fetchall())


def test_queries_without_sql_give_rows(spark):
    assert QUERIES["nystroem_pool"](spark, SF).count() > 0 and QUERIES["tissue_contours"](spark, SF).count() > 0
