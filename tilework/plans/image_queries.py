"""Further registered queries: rasters, encoders, probes and what cohorts are checked by. Importing this adds them to QUERIES and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotations as an
from ..operators import learning, pooling, rasters, shapes
from ..streaming.tiles import counts_by_window
from .queries import QUERIES, SQL, features, image_pixels, mask, otsu_threshold, query, table, vertices

__all__ = ["QUERIES", "SQL"]

#: Grey images of 8 x 8 pixels, one an embedding.
SIDE = 8


def gray(spark, d):
    p = image_pixels(spark, d).select(F.col("image_id").alias("slide_id"), F.posexplode("px").alias("i", "v"))
    return p.select("slide_id", F.floor(F.col("i") / SIDE).cast("int").alias("row"), (F.col("i") % SIDE).alias("col"), "v")


#: Orders whose pixels share a slide of 128 x 128 pixels, about a fifth of which they fill; slides grow in number with the table.
CROWD, CANVAS = 1000, 128


def crowded(spark, d):
    row = (F.col("l_partkey") * 7 + F.col("l_linenumber") * 13) % CANVAS
    col = (F.col("l_orderkey") * 31 + F.col("l_suppkey") * 17 + F.col("l_linenumber")) % CANVAS
    return table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / CROWD).alias("slide_id"), row.cast("int").alias("row"), col.cast("int").alias("col"))


_CROWDED = f"""crowded AS (SELECT DISTINCT l_orderkey // {CROWD} AS slide_id, CAST((l_partkey * 7 + l_linenumber * 13) % {CANVAS} AS INT) AS "row", CAST((l_orderkey * 31 + l_suppkey * 17 + l_linenumber) % {CANVAS} AS INT) AS col FROM lineitem)"""


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_patches(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_anti")


@query("SELECT image_id, label, round(e0, 6) AS e0 FROM features JOIN (SELECT p_partkey AS image_id FROM part) USING (image_id)")
def feature_lookup(spark, d):
    wanted = table(spark, d, "part").select(F.col("p_partkey").alias("image_id"))
    return features(spark, d).select("image_id", "label", F.round("e0", 6).alias("e0")).join(wanted, "image_id")


@query("SELECT slide_id, CAST(width - width % 1024 AS INT) AS width, CAST(height - height % 1024 AS INT) AS height FROM slides")
def center_crop(spark, d):
    s = table(spark, d, "part")
    crop = lambda c: (c - c % 1024).cast("int")
    return s.select(F.col("p_partkey").alias("slide_id"), crop(F.col("p_size") * 256).alias("width"), crop(F.col("p_size") * 128).alias("height"))


@query("SELECT slide_id, CAST(len(tiles) AS INT) AS n, list_aggregate(list_concat(tiles, list_transform(range(30 - len(tiles)), lambda i: -1)), 'string_agg', ',') AS tiles FROM (SELECT slide_id, list_sort(list(tile_no)) AS tiles FROM features GROUP BY 1)")
def pad_mask(spark, d):
    rows = features(spark, d).groupBy("slide_id").agg(F.array_sort(F.collect_list("tile_no")).alias("tiles"))
    return rows.select("slide_id", F.size("tiles").alias("n"), F.concat_ws(",", pooling.padded(F.col("tiles"), 30, F.lit(-1))["values"].cast("array<string>")).alias("tiles"))


@query("SELECT round(avg(ln(exp(z0) + exp(z1)) - CASE WHEN y = 1 THEN z1 ELSE z0 END), 6) AS loss FROM (SELECT e0 AS z0, e1 AS z1, label % 2 AS y FROM features)")
def ce_loss(spark, d):
    top = F.greatest("e0", "e1")
    whole = top + F.log(F.exp(F.col("e0") - top) + F.exp(F.col("e1") - top))
    return features(spark, d).agg(F.round(F.avg(whole - F.when(F.col("label") % 2 == 1, F.col("e1")).otherwise(F.col("e0"))), 6).alias("loss"))


@query("SELECT doc_id, base64(unhex(sha256('lang=' || lang || ';source=' || source))) AS name FROM documents")
def experiment_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.base64(F.unhex(F.sha2(F.concat(F.lit("lang="), "lang", F.lit(";source="), "source"), 256))).alias("name"))


@query("SELECT day, label, count(*) AS n FROM (SELECT CAST(ts AS DATE) AS day, event_type AS label FROM events) GROUP BY ALL")
def event_windows(spark, d):
    """What streaming.tiles counts by window, on the whole table; days are those of the timestamps as written."""
    e = table(spark, d, "events").select(F.convert_timezone(F.lit("UTC"), F.current_timezone(), "ts").alias("ts"), "event_type")
    found = counts_by_window(e, "ts", "event_type")
    return found.select(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("start").cast("timestamp_ntz")).cast("date").alias("day"), "label", "n")


_EDGES = """e AS (SELECT * FROM (SELECT slide_id, label, x, y // 16 AS y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y // 16) OVER w, first_value(y // 16) OVER w) AS ny FROM vertices WINDOW w AS (PARTITION BY slide_id, label, roi_id ORDER BY vertex_id)) WHERE y <> ny),
c AS (SELECT slide_id, label, r AS "row", x + ((r - y) * (nx - x))::DOUBLE / (ny - y) AS cut FROM e, unnest(range(least(y, ny), greatest(y, ny))) t(r)),
runs AS (SELECT * FROM (SELECT slide_id, label, "row", ceil(cut) AS lo, floor(lead(cut) OVER w) AS hi, (row_number() OVER w) % 2 AS opens FROM c WINDOW w AS (PARTITION BY slide_id, label, "row" ORDER BY cut)) WHERE opens = 1 AND hi >= lo)"""


@query(f', {_EDGES} SELECT slide_id, label, "row", count(*) AS n_runs, CAST(sum(hi - lo + 1) AS BIGINT) AS n_pixels FROM runs GROUP BY ALL')
def raster_mask(spark, d):
    v = vertices(spark, d).withColumn("y", F.floor(F.col("y") / 16).cast("int"))
    return rasters.fill_polygons(v).groupBy("slide_id", "label", F.col("row").cast("long").alias("row")).agg(F.count("*").alias("n_runs"), F.sum(F.col("hi") - F.col("lo") + 1).alias("n_pixels"))


def components(spark, d):
    found = rasters.component_boxes(rasters.components(crowded(spark, d)))
    return found.select("slide_id", F.col("component.row").alias("row"), F.col("component.lo").alias("col"), "area", "row_min", "row_max", "col_min", "col_max")


def largest_components(spark, d):
    found = rasters.component_boxes(rasters.components(crowded(spark, d)), min_size=1, largest=3)
    return found.select("slide_id", F.col("component.row").alias("row"), F.col("component.lo").alias("col"), "area")


def mask_polygons(spark, d):
    return an.polygon_measures(rasters.hulls(rasters.components(crowded(spark, d))))


@query(f""", {_CROWDED} SELECT slide_id, CAST(count(*) AS BIGINT) AS area, CAST(sum(4 - n) AS BIGINT) AS perimeter FROM (SELECT slide_id, "row", col,
(SELECT count(*) FROM (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) s(a, b) JOIN crowded q ON q.slide_id = p.slide_id AND q."row" = p."row" + a AND q.col = p.col + b) AS n FROM crowded p) GROUP BY 1""")
def contours(spark, d):
    """Of each slide what its contours measure: areas less holes, and lengths; the SQL counts pixels and their bare sides."""
    measured = shapes.contour_measures(shapes.contours(rasters.components(crowded(spark, d))))
    return measured.groupBy("slide_id").agg(F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"))


def split_shapes(spark, d):
    """Pixels of every shape that components fall into."""
    parts = shapes.split_touching(rasters.components(rasters.dilate(crowded(spark, d))), 10)
    return parts.groupBy("slide_id", "peak_row", "peak_col").agg(F.count("*").alias("n_pixels"), F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"))


QUERIES["split_shapes"] = split_shapes
QUERIES |= {f.__name__: f for f in (components, largest_components, mask_polygons)}


def _grown(source: str, sign: str) -> str:
    return f'SELECT slide_id, "row" {sign} a AS "row", col {sign} b AS col, count(*) AS n FROM {source}, unnest(range(2)) s(a), unnest(range(2)) t(b) GROUP BY ALL'


@query(f"""SELECT * EXCLUDE (n) FROM (WITH g AS (SELECT image_id AS slide_id, CAST(i // 8 AS INT) AS "row", CAST(i % 8 AS INT) AS col, px[i + 1] AS v FROM pixels, unnest(range(64)) t(i)),
m AS (SELECT slide_id, "row", col FROM g WHERE v > 25 AND v < (SELECT threshold FROM ({SQL["otsu_threshold"]}))),
m1 AS ({_grown("m", "+")}), m2 AS (SELECT * FROM ({_grown("m1", "-")}) WHERE n = 4), m3 AS (SELECT * FROM ({_grown("m2", "-")}) WHERE n = 4), m4 AS ({_grown("m3", "+")}) SELECT slide_id, CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, n FROM m4)""")
def tissue_mask(spark, d):
    return rasters.tissue_mask(gray(spark, d), otsu_threshold(spark, d).first()["threshold"])


@query("""SELECT image_id, round(avg(e), 6) AS entropy FROM (SELECT image_id, i, -sum(p * log2(p)) AS e FROM (SELECT image_id, i, n / sum(n) OVER (PARTITION BY image_id, i) AS p FROM
(SELECT image_id, i, px[j + 1] AS v, count(*) AS n FROM pixels, unnest(range(64)) a(i), unnest(range(64)) b(j) WHERE (i // 8 - j // 8) ** 2 + (i % 8 - j % 8) ** 2 <= 9 GROUP BY ALL)) GROUP BY ALL) GROUP BY 1""")
def local_entropy(spark, d):
    return rasters.mean_local_entropy(image_pixels(spark, d), "image_id", "px", SIDE, 3)


@query("""SELECT slide_id, CAST(x AS INT) AS "row", CAST(min(y) AS INT) AS col, string_agg(v, ',' ORDER BY y) AS line FROM (SELECT image_id // 25 AS slide_id, image_id % 25 // 5 * 8 + i // 8 AS x, image_id % 5 * 8 + i % 8 AS y, px[i + 1] AS v FROM pixels, unnest(range(64)) t(i)) GROUP BY 1, 2""")
def stitch_canvas(spark, d):
    tiles = image_pixels(spark, d).select(F.floor(F.col("image_id") / 25).alias("slide_id"), F.floor(F.col("image_id") % 25 / 5).cast("int").alias("r"), (F.col("image_id") % 5 * SIDE).cast("int").alias("y"), "px").withColumn("x", F.col("r") * SIDE)
    return rasters.canvas(tiles, SIDE).select("slide_id", "row", "col", F.concat_ws(",", F.col("line").cast("array<string>")).alias("line"))


@query("SELECT vec_id AS image_id, CAST(k AS INT) AS pos, round(sum(embedding[i + 1]::DOUBLE * cos(i * k * pi() / 8)), 5) AS v FROM embeddings, unnest(range(64)) t(i), unnest(range(8)) u(k) GROUP BY 1, 2")
def encode_tiles(spark, d):
    made = learning.encode(features(spark, d), "image_id", "embedding", "cosine8")
    return made.select("image_id", F.posexplode("features").alias("pos", "v")).withColumn("v", F.round("v", 5))


@query("""SELECT slide_id, CAST(i AS INT) AS pos, round(avg(m), 6) AS by_region, round(sum(s) / sum(n), 6) AS by_tile FROM (SELECT slide_id, tile_no // 4 AS region, i, avg(embedding[i + 1]::DOUBLE) AS m, sum(embedding[i + 1]::DOUBLE) AS s, count(*) AS n FROM features, unnest(range(64)) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def hier_embed(spark, d):
    long = features(spark, d).select("slide_id", F.floor(F.col("tile_no") / 4).alias("region"), F.posexplode("embedding").alias("pos", "v"))
    v = F.col("v").cast("double")
    regions = long.groupBy("slide_id", "region", "pos").agg(F.avg(v).alias("m"), F.sum(v).alias("s"), F.count("*").alias("n"))
    return regions.groupBy("slide_id", "pos").agg(F.round(F.avg("m"), 6).alias("by_region"), F.round(F.sum("s") / F.sum("n"), 6).alias("by_tile"))


def pca(spark, d):
    fitted = learning.principal_components(features(spark, d), "embedding", 4)
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(fitted.explainedVariance.toArray())], "component int, explained double")


def _binary(spark, d):
    return features(spark, d).select("image_id", "embedding", (F.col("label") >= 5).cast("int").alias("y"))


def linear_probe(spark, d):
    rows = _binary(spark, d)
    return learning.linear_probe(rows.where("image_id % 4 <> 0"), rows.where("image_id % 4 = 0"), "image_id", "embedding", "y", portion=0.5).withColumn("p", F.round("p", 4))


def nested_cv(spark, d):
    return learning.nested_cv(_binary(spark, d), "image_id", "embedding", "y", [0.001, 0.1])


QUERIES |= {f.__name__: f for f in (pca, linear_probe, nested_cv)}

#: Names that queries over whole tables had beside filtered ones of old.
for _name in ("cindex", "missing_patches", "outer_join_chain", "label_right_join"):
    QUERIES[f"{_name}_all"], SQL[f"{_name}_all"] = QUERIES[_name], SQL[_name]
