"""Further registered queries: borders and levels, regions, folds, pooling and metrics over several classes. Importing this adds them to QUERIES and SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import annotations as an
from ..operators import cohorts, metrics, pixels, pooling, rasters, regions, tiles
from ..sources import catalogue, stores
from .image_queries import QUERIES, SIDE, SQL, gray
from .queries import features, image_pixels, mask, query, slides, table, vertices

__all__ = ["QUERIES", "SQL"]


def _text(values):
    return F.concat_ws(",", values.cast("array<string>"))


# -- grids and regions ---------------------------------------------------------

_BORDERED = "bordered AS (SELECT slide_id, slide_id % 64 AS x_min, height - slide_id % 32 AS x_max, slide_id % 48 AS y_min, width AS y_max, 1 + slide_id % 2 AS ds FROM slides)"


def _bordered(spark, d):
    s = slides(spark, d)
    return s.select("*", (F.col("slide_id") % 64).alias("x_min"), (F.col("height") - F.col("slide_id") % 32).alias("x_max"), (F.col("slide_id") % 48).alias("y_min"), F.col("width").alias("y_max"), (1 + F.col("slide_id") % 2).alias("ds"))


@query(f", {_BORDERED} SELECT slide_id, x::INT AS x, y::INT AS y FROM bordered, unnest(range(x_min, x_max, 256 * ds)) a(x), unnest(range(y_min, y_max, 256 * ds)) b(y)")
def tile_grid_border(spark, d):
    return tiles.tile_grid(_bordered(spark, d), 512, 256, downsample="ds")


@query(f", {_BORDERED} SELECT slide_id, x::INT AS x, y::INT AS y FROM bordered, unnest(range(x_min, x_max, 512 * ds)) a(x), unnest(range(y_min, y_max, 512 * ds)) b(y) WHERE x + 512 * ds <= x_max AND y + 512 * ds <= y_max")
def tile_grid_border_edges(spark, d):
    return tiles.tile_grid(_bordered(spark, d), 512, drop_edges=True, downsample="ds")


@query("SELECT slide_id, CAST(512 * (1 + slide_id % 4) AS INT) AS extent FROM slides")
def tile_extent(spark, d):
    return slides(spark, d).select("slide_id", tiles.tile_extent(512, 1.5 + F.col("slide_id") % 4).alias("extent"))


@query("SELECT slide_id, ceil(height / 512::DOUBLE)::BIGINT * ceil(width / 512::DOUBLE)::BIGINT AS n_tiles FROM slides")
def tile_counts(spark, d):
    return slides(spark, d).select("slide_id", (tiles.tile_count(F.col("height"), 512) * tiles.tile_count(F.col("width"), 512)).alias("n_tiles"))


_NEAREST = "(CASE WHEN 2 * (width % 1000) <= 1000 THEN width - width % 1000 ELSE width - width % 1000 + 1000 END)"


@query(f"SELECT slide_id, greatest({_NEAREST}, 3000)::BIGINT AS ge, greatest({_NEAREST}, 4000)::BIGINT AS gt, least({_NEAREST}, 2000)::BIGINT AS lt FROM slides")
def snap_thresholds(spark, d):
    snap = lambda o: tiles.snap_dimension(F.col("width"), 1000, 3000, o)
    return slides(spark, d).select("slide_id", snap("=>").alias("ge"), snap(">").alias("gt"), snap("<").alias("lt"))


@query("SELECT slide_id, CAST(round_even(1001::DOUBLE * (width // 3) / width, 0) AS BIGINT) AS x, CAST(round_even(777::DOUBLE * 2 / 8, 0) AS BIGINT) AS size FROM slides")
def level_sizes(spark, d):
    return slides(spark, d).select("slide_id", tiles.point_at_level(F.lit(1001), F.col("width"), F.floor(F.col("width") / 3)).alias("x"), tiles.size_between(F.lit(777), F.lit(2), F.lit(8)).alias("size"))


@query("SELECT slide_id, 3000 AS x, 512 AS y, CAST(floor(greatest(least(1500, width - 3000), 0) / 2::DOUBLE) AS BIGINT) AS w, CAST(floor(greatest(least(1000, height - 512), 0) / 2::DOUBLE) AS BIGINT) AS h FROM slides")
def region_snapped(spark, d):
    return slides(spark, d).select("slide_id", F.inline(F.array(tiles.region_window(F.lit(3000), F.lit(512), F.lit(1200), F.lit(700), F.col("width"), F.col("height"), 1, factor=500))))


_TILES = "grid AS (SELECT DISTINCT slide_id, x::INT AS x, y::INT AS y FROM (SELECT DISTINCT slide_id FROM mask), unnest(range(3, 64, 8)) a(x), unnest(range(5, 64, 8)) b(y))"


def _shifted_grid(spark, d):
    s = mask(spark, d).select("slide_id").distinct().select("slide_id", *[F.lit(v).alias(c) for c, v in (("width", 64), ("height", 64), ("x_min", 3), ("x_max", 64), ("y_min", 5), ("y_max", 64))])
    return tiles.tile_grid(s, 16, 8)


@query(f', {_TILES} SELECT slide_id, x, y, count(*) AS pixels FROM grid JOIN mask USING (slide_id) WHERE class_id = 1 AND "row" >= x AND "row" < x + 16 AND col >= y AND col < y + 16 GROUP BY ALL HAVING count(*) >= 0.003 * 256')
def tissue_filter_overlap(spark, d):
    return tiles.tissue_filter(_shifted_grid(spark, d), mask(spark, d), 16, 1, 0.003, stride=8)


@query("SELECT image_id FROM pixels WHERE NOT len(list_filter(px, lambda v: v <= 115))::DOUBLE / len(px) > 0.3")
def filter_tiles_column(spark, d):
    return tiles.filter_tiles(image_pixels(spark, d), lambda px, area: pixels.dark_share(px, 115) > area, area=0.3).select("image_id")


@query("SELECT image_id FROM pixels WHERE NOT list_sum(px)::DOUBLE / len(px) > 128")
def filter_tiles_array(spark, d):
    p = image_pixels(spark, d).select("image_id", "px")
    return tiles.filter_tiles(p, lambda tile, most: tile.mean() > most, shape=(SIDE, SIDE), most=128).select("image_id")


@query("""SELECT slide_id, draw::INT AS draw, image_id FROM (SELECT slide_id, draw, ('0x' || sha256(concat_ws('|', slide_id::VARCHAR, draw::VARCHAR, '7'))[1:8])::BIGINT % n AS place FROM (SELECT slide_id, count(*) AS n FROM features GROUP BY 1), unnest(range(4)) t(draw))
JOIN (SELECT slide_id, image_id, row_number() OVER (PARTITION BY slide_id ORDER BY sha256(concat_ws('|', image_id::VARCHAR, '7')), image_id) - 1 AS place FROM features) USING (slide_id, place)""")
def sample_replacement(spark, d):
    return tiles.sample_with_replacement(features(spark, d).select("image_id", "slide_id"), "slide_id", ["image_id"], 4, seed=7).select("slide_id", "draw", "image_id")


@query("SELECT vertex_id, 'tiles_' || y || '_' || x || '.png' AS path FROM vertices")
def tile_metadata(spark, d):
    v = vertices(spark, d)
    return v.select("vertex_id", "x", "y").join(stores.tile_metadata(v, "tiles").distinct(), ["x", "y"]).select("vertex_id", "path")


# -- pixels --------------------------------------------------------------------


@query("SELECT image_id::VARCHAR AS slide_id, x::INT AS x, y::INT AS y, list_aggregate(list_transform(range(16), lambda i: printf('%02X', px[(x + i // 4) * 8 + y + i % 4 + 1])), 'string_agg', '') AS data FROM pixels, unnest([0, 4]) a(x), unnest([0, 4]) b(y)")
def region_pixels(spark, d):
    data = F.unhex(F.array_join(F.transform("px", lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    images = image_pixels(spark, d).select(F.col("image_id").alias("slide_id"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.lit(1).alias("channels"), data.alias("data"))
    grid = tiles.tile_grid(images.select("slide_id", "width", "height"), 4)
    return regions.extract_tiles(images, grid, 4).select("slide_id", "x", "y", F.hex("data").alias("data"))


@query("SELECT image_id, list_aggregate(list_transform(range(16), lambda i: (px[i // 4 * 16 + i % 4 * 2 + 1] + px[i // 4 * 16 + i % 4 * 2 + 2] + px[i // 4 * 16 + i % 4 * 2 + 9] + px[i // 4 * 16 + i % 4 * 2 + 10] + 2) // 4), 'string_agg', ',') AS px FROM pixels")
def downsample_tile(spark, d):
    return image_pixels(spark, d).select("image_id", _text(regions.shrink_pixels(F.col("px"), SIDE, 2)).alias("px"))


@query("SELECT image_id, r::INT AS patch_row, c::INT AS patch_col, list_aggregate(list_transform(range(16), lambda i: px[(r * 4 + i // 4) * 8 + c * 4 + i % 4 + 1]), 'string_agg', ',') AS px FROM pixels, unnest([0, 1]) a(r), unnest([0, 1]) b(c)")
def unfold_patches(spark, d):
    return regions.unfold(image_pixels(spark, d).select("image_id", "px"), "px", SIDE, 4).withColumn("px", _text(F.col("px")))


@query("SELECT image_id, list_aggregate(px, 'string_agg', ',') AS px FROM pixels")
def fold_patches(spark, d):
    patches = regions.unfold(image_pixels(spark, d).select("image_id", "px"), "px", SIDE, 4)
    return regions.fold(patches, "image_id", "px", SIDE, 4).withColumn("px", _text(F.col("px")))


@query("SELECT image_id, list_aggregate(list_transform(range(100), lambda i: CASE WHEN i // 10 BETWEEN 1 AND 8 AND i % 10 BETWEEN 1 AND 8 THEN px[(i // 10 - 1) * 8 + i % 10] ELSE 255 END), 'string_agg', ',') AS px FROM pixels")
def add_margin(spark, d):
    return image_pixels(spark, d).select("image_id", _text(regions.with_margin(F.col("px"), SIDE, 1)).alias("px"))


@query("SELECT image_id, list_aggregate(list_transform(range(128), lambda i: CASE WHEN i % 16 < 8 THEN px[i // 16 * 8 + i % 16 + 1] ELSE 255 - px[i // 16 * 8 + i % 16 - 7] END), 'string_agg', ',') AS px FROM pixels")
def concat_images(spark, d):
    inverse = F.transform("px", lambda v: 255 - v)
    return image_pixels(spark, d).select("image_id", _text(regions.side_by_side(F.col("px"), inverse, SIDE)).alias("px"))


@query("SELECT image_id, list_aggregate(list_transform(px, lambda v: 255 - v), 'string_agg', ',') AS px FROM pixels")
def colour_map(spark, d):
    return image_pixels(spark, d).select("image_id", _text(regions.colour_map(F.col("px"), lambda x: 1 - x)).alias("px"))


_RGB = ", ".join("CASE class_id " + " ".join(f"WHEN {i + 1} THEN {round(p[k], 6)}::DOUBLE" for i, p in enumerate(rasters.palette(7))) + f" ELSE 0.0 END AS {c}" for k, c in enumerate("rgb"))


@query(f"SELECT DISTINCT class_id, {_RGB} FROM mask")
def mask_colours(spark, d):
    return rasters.coloured(mask(spark, d).select("class_id").distinct(), 7)


@query('SELECT image_id AS slide_id, CAST(i // 8 AS INT) AS "row", CAST(i % 8 AS INT) AS col, CASE WHEN px[i + 1] > 120 THEN px[i + 1] ELSE 255 END AS v FROM pixels, unnest(range(64)) t(i)')
def mask_white_out(spark, d):
    g = gray(spark, d)
    return rasters.white_out(g, g.where("v > 120"), ["v"])


@query('SELECT image_id AS slide_id, CAST(i // 8 AS INT) AS "row", CAST(i % 8 AS INT) AS col, round(CASE WHEN px[i + 1] / 2::DOUBLE >= 60 THEN 0.4::DOUBLE * (px[i + 1] / 2::DOUBLE) + 0.6::DOUBLE * px[i + 1] ELSE px[i + 1] END, 6) AS v FROM pixels, unnest(range(64)) t(i)')
def heatmap_alpha(spark, d):
    g = gray(spark, d)
    return rasters.blended(g, g.select("slide_id", "row", "col", (F.col("v") / 2).alias("heat")), 0.4, 60)


@query("""SELECT slide_id, CAST(x AS INT) AS "row", CAST(min(y) AS INT) AS col, list_aggregate(list_transform(range(min(y), max(y) + 1), lambda c: coalesce(map_from_entries(list((y, v)))[c], 255)), 'string_agg', ',') AS line FROM
(SELECT image_id // 25 AS slide_id, image_id % 25 // 5 * 8 + i // 8 AS x, image_id % 5 * 8 + i % 8 AS y, px[i + 1] AS v FROM pixels, unnest(range(64)) t(i) WHERE label <> 3) GROUP BY 1, 2""")
def stitch_canvas_gaps(spark, d):
    """Canvases where the tiles of one label are missing."""
    some = image_pixels(spark, d).where("label <> 3").select(F.floor(F.col("image_id") / 25).alias("slide_id"), (F.floor(F.col("image_id") % 25 / 5) * SIDE).cast("int").alias("x"), (F.col("image_id") % 5 * SIDE).cast("int").alias("y"), "px")
    return rasters.canvas(some, SIDE).select("slide_id", "row", "col", _text(F.col("line")).alias("line"))


@query('SELECT slide_id, CAST(round_even(min("row") * 2.5::DOUBLE, 0) AS BIGINT) AS row_min, CAST(round_even(max("row") * 2.5::DOUBLE, 0) AS BIGINT) AS row_max, CAST(round_even(min(col) * 1.5::DOUBLE, 0) AS BIGINT) AS col_min, CAST(round_even(max(col) * 1.5::DOUBLE, 0) AS BIGINT) AS col_max FROM mask WHERE class_id <> 0 GROUP BY 1')
def boxes_at_source(spark, d):
    return rasters.to_source_level(an.mask_bbox(mask(spark, d)).drop("n_pixels"), 1.5, 2.5)


@query("""SELECT slide_id, label, roi_id, CASE WHEN abs(sum(k)) > 0 THEN round(sum((x + nx) * k) / (3 * sum(k)), 3) END AS cx, CASE WHEN abs(sum(k)) > 0 THEN round(sum((y + ny) * k) / (3 * sum(k)), 3) END AS cy FROM (SELECT *, x * ny - nx * y AS k FROM (
SELECT slide_id, label, roi_id, x::DOUBLE AS x, y::DOUBLE AS y, coalesce(lead(x) OVER w, first_value(x) OVER w)::DOUBLE AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w)::DOUBLE AS ny FROM vertices WINDOW w AS (PARTITION BY slide_id, label, roi_id ORDER BY vertex_id))) GROUP BY ALL""")
def polygon_centroids(spark, d):
    return an.polygon_centroids(vertices(spark, d))


@query("""SELECT slide_id, x, y, list_aggregate(list_transform(range(16), lambda i: coalesce(m[i::INT], 0)), 'string_agg', ',') AS classes FROM (SELECT DISTINCT slide_id, x::INT AS x, y::INT AS y FROM (SELECT DISTINCT slide_id FROM mask), unnest(range(0, 64, 32)) a(x), unnest(range(0, 64, 32)) b(y))
LEFT JOIN (SELECT slide_id, x, y, map_from_entries(list((i, c))) AS m FROM (SELECT slide_id, ("row" // 32 * 32)::INT AS x, (col // 32 * 32)::INT AS y, ("row" % 32 // 8 * 4 + col % 32 // 8)::INT AS i, max(class_id) AS c FROM mask WHERE "row" % 8 = 4 AND col % 8 = 4 GROUP BY ALL) GROUP BY ALL) USING (slide_id, x, y)""")
def tile_masks(spark, d):
    m = mask(spark, d)
    grid = tiles.tile_grid(m.select("slide_id").distinct().select("slide_id", F.lit(64).alias("width"), F.lit(64).alias("height")), 32)
    return regions.extract_masks(m, grid, 32, 4).withColumn("classes", _text(F.col("classes")))


# -- cohorts -------------------------------------------------------------------


_SHAPES = "shapes AS (SELECT source, string_agg(lang || '=' || n, ',' ORDER BY lang || '=' || n) AS shape FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY 1)"


@query(f""", {_SHAPES} SELECT doc_id, fold FROM documents JOIN (SELECT source, CAST((row_number() OVER (PARTITION BY shape ORDER BY sha256(concat_ws('|', source, '42')), source) - 1 + ('0x' || sha256(shape)[1:6])::BIGINT) % 5 AS INT) AS fold FROM shapes) USING (source)""")
def split_by_patient(spark, d):
    return cohorts.split_cv(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id", 5, "patient_split", "lang", patient="source").select("doc_id", "fold")


@query("SELECT doc_id, CAST((row_number() OVER (PARTITION BY quality ORDER BY sha256(concat_ws('|', doc_id::VARCHAR, '42')), doc_id) - 1) % 3 AS INT) AS fold FROM labels")
def split_by_few_centers(spark, d):
    """Two centres are fewer than three folds, so rows count alone."""
    return cohorts.split_cv(table(spark, d, "labels"), "doc_id", 3, "center_split", "quality", center="toxic").select("doc_id", "fold")


@query(f""", {_SHAPES}, folds AS (SELECT source, fold FROM documents JOIN (SELECT source, CAST((row_number() OVER (PARTITION BY shape ORDER BY sha256(concat_ws('|', source, '42')), source) - 1 + ('0x' || sha256(shape)[1:6])::BIGINT) % 5 AS INT) AS fold FROM shapes) USING (source))
SELECT source, CAST(count(DISTINCT fold) AS INT) AS n_folds FROM folds GROUP BY 1 HAVING count(DISTINCT fold) > 1""")
def folds_disjoint(spark, d):
    """No source lies in two folds."""
    folds = cohorts.split_cv(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id", 5, "patient_split", "lang", patient="source")
    return cohorts.disjoint(folds, "source").withColumn("n_folds", F.col("n_folds").cast("int"))


@query("SELECT doc_id FROM labels QUALIFY row_number() OVER (ORDER BY sha256(concat_ws('|', doc_id::VARCHAR, '5')), doc_id) <= floor(0.3::DOUBLE * (SELECT count(*) FROM labels))")
def training_portion(spark, d):
    return cohorts.training_portion(table(spark, d, "labels").select("doc_id"), "doc_id", 0.3, seed=5)


@query("SELECT CAST(CAST(n_chars > 0 AS INT) AS VARCHAR) AS label, count(*) AS n FROM documents GROUP BY 1")
def labels_by_sign(spark, d):
    return cohorts.labels_distribution(table(spark, d, "documents"), "n_chars")


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def first_of_each(spark, d):
    return cohorts.first_of_each(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id")


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS images_without, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS masks_without")
def masks_missing(spark, d):
    name = lambda t: table(spark, d, t).select(F.concat(F.lit("m_"), "doc_id").alias("name"))
    return cohorts.matched_names(name("documents"), name("labels"))[1]


@query("""SELECT lr AS "lr", depth AS "model.depth", act AS "model.act", 7 AS "seed" FROM (VALUES (0.1::DOUBLE), (0.01)) a(lr), (VALUES (1), (2)) b(depth), (VALUES ('relu')) c(act)""")
def grid_nested(spark, d):
    return cohorts.permutations(spark, {"lr": [0.1, 0.01], "model": {"depth": [1, 2], "act": "relu"}, "seed": 7})


@query("SELECT doc_id, replace(base64(unhex(sha256('lang=' || lang || ';model.depth=2;source=' || source))), '/', '0') AS name FROM documents")
def experiment_names(spark, d):
    return table(spark, d, "documents").select("doc_id", cohorts.experiment_name({"source": F.col("source"), "lang": F.col("lang"), "model.depth": F.lit(2)}).alias("name"))


@query("SELECT doc_id, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 END AS lang FROM documents")
def dict_label_map(spark, d):
    return cohorts.map_labels(table(spark, d, "documents").select("doc_id", "lang"), "lang", {"de": 0, "en": 1})


@query("""SELECT format('patch_patient_{:03d}_node_{}_x_{}_y_{}', o_custkey % 1000, o_orderkey % 5, o_orderkey // 5, o_custkey) AS image_id, format('p/patient_{:03d}_node_{}/patch_patient_{:03d}_node_{}_x_{}_y_{}.png', o_custkey % 1000, o_orderkey % 5, o_custkey % 1000, o_orderkey % 5, o_orderkey // 5, o_custkey) AS image_path,
CAST(o_orderkey % 2 AS INT) AS label, CAST(o_custkey % 5 AS INT) AS center_id FROM orders WHERE o_custkey % 5 IN (0, 3, 4)""")
def camelyon17_train(spark, d):
    o = table(spark, d, "orders")
    meta = o.select((F.col("o_custkey") % 1000).alias("patient"), (F.col("o_orderkey") % 5).alias("node"), F.floor(F.col("o_orderkey") / 5).alias("x_coord"), F.col("o_custkey").alias("y_coord"), (F.col("o_orderkey") % 2).alias("tumor"), (F.col("o_custkey") % 5).alias("center"))
    return catalogue.camelyon17(meta, "TRAIN", "p")


@query("SELECT slide_id, label, CAST(count(*) AS INT) AS n, round(sum(e0), 5) AS total FROM (SELECT slide_id, tile_no, e0 FROM features WHERE tile_no < 10) JOIN (SELECT p_partkey AS slide_id, p_size AS label FROM part) USING (slide_id) GROUP BY ALL")
def slide_dataset(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("slide_id"), F.col("p_partkey").alias("patient_id"), F.col("p_size").alias("label"))
    made = catalogue.slide_dataset(rows, features(spark, d), 10)
    total = F.aggregate("features", F.lit(0.0), lambda acc, v: acc + v[0].cast("double"))
    return made.select("slide_id", "label", F.size("features").alias("n"), F.round(total, 5).alias("total"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def completed_experiments(spark, d):
    status = F.struct((F.col("o_orderstatus") == "F").alias("completed")).alias("status")
    return catalogue.completed(table(spark, d, "orders").select("o_orderkey", status)).select("o_orderkey")


# -- pooling and metrics -------------------------------------------------------


@query("SELECT image_id, round(1 / (1 + exp(-e0)), 6) AS p FROM features")
def sigmoid(spark, d):
    return features(spark, d).select("image_id", F.round(pooling.sigmoid(F.col("e0")), 6).alias("p"))


_V, _U, _W = ([[round(f(1 + i * j), 3) for j in range(4)] for i in range(2)] for f in (math.cos, math.sin, math.cos))


def _sql_dot(weights):
    return "(" + " + ".join(f"({w}::DOUBLE) * embedding[{j + 1}]::DOUBLE" for j, w in enumerate(weights)) + ")"


_GATE = " + ".join(f"({w[1]}::DOUBLE) * tanh({_sql_dot(v)}) / (1 + exp(-{_sql_dot(u)}))" for v, u, w in zip(_V, _U, _W, strict=True))


@query(f"SELECT slide_id, CAST(i AS INT) AS pos, round(sum(exp(s) * embedding[i + 1]::DOUBLE) / sum(exp(s)), 6) AS pooled FROM (SELECT slide_id, embedding, ({_GATE}) / 2 AS s FROM features), unnest(range(4)) t(i) GROUP BY ALL")
def gated_attention(spark, d):
    f = features(spark, d).select("slide_id", F.slice("embedding", 1, 4).alias("embedding"))
    return pooling.gated_attention_pool(f, "slide_id", "embedding", _V, _U, [w[1] for w in _W], 2.0)


@query("""SELECT slide_id, CAST(i AS INT) AS pos, round(sum(exp(s) * embedding[i + 1]::DOUBLE) / sum(exp(s)), 6) AS pooled FROM (SELECT slide_id, f.embedding, list_sum(list_transform(range(1, 65), lambda i: f.embedding[i]::DOUBLE * c.embedding[i]::DOUBLE)) / 8 AS s
FROM features f JOIN (SELECT slide_id, embedding FROM features QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY e0 DESC, image_id) = 1) c USING (slide_id)), unnest(range(64)) t(i) GROUP BY ALL""")
def critical_attention(spark, d):
    return pooling.critical_attention_pool(features(spark, d), "slide_id", "image_id", "e0", "embedding")


@query("SELECT slide_id, round(0.5::DOUBLE * (max(e0) + avg(e1)), 6) AS logit FROM features GROUP BY 1")
def branch_mean(spark, d):
    return pooling.mean_of_branches(features(spark, d).groupBy("slide_id").agg(F.max("e0").alias("top"), F.avg("e1").alias("bag")), "slide_id", "top", "bag")


@query("SELECT slide_id, list_aggregate(list_transform(range(30), lambda i: i >= 25 OR i >= n), 'string_agg', ',') AS padded FROM (SELECT slide_id, count(*) AS n FROM features GROUP BY 1)")
def padding_mask(spark, d):
    """Lists of at most 25 tiles, cut or filled up to 30."""
    rows = features(spark, d).groupBy("slide_id").agg(F.array_sort(F.collect_list("tile_no")).alias("tiles"))
    return rows.select("slide_id", _text(pooling.padded(F.col("tiles"), 30, F.lit(-1))["mask"]).alias("padded"))


def _ten(spark, d):
    return features(spark, d).select("image_id", "label", F.transform(F.slice("embedding", 1, 10), lambda v: v.cast("double")).alias("scores"))


@query("SELECT round(avg(CASE WHEN list_position(s, list_max(s)) - 1 = label THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, count(*) AS n FROM (SELECT label, embedding[1:10] AS s FROM features)")
def multiclass_accuracy(spark, d):
    return metrics.multiclass_accuracy(_ten(spark, d), "scores", "label")


@query(f"SELECT round(CASE WHEN count(*) = count(auc) THEN avg(auc) END, 6) AS mean_auc, count(*) AS n_classes FROM (WITH x AS (SELECT 1) SELECT * FROM ({SQL['macro_ovr_auc']}))")
def macro_auc(spark, d):
    return metrics.mean_auc(QUERIES["macro_ovr_auc"](spark, d))


@query("""SELECT class, auc, acc, f1 FROM (SELECT class, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2::DOUBLE) / (sum(y) * sum(1 - y)), 6) AS auc, round(avg(CASE WHEN y = said THEN 1.0::DOUBLE ELSE 0 END), 6) AS acc, round(2 * sum(y * said)::DOUBLE / greatest(sum(y) + sum(said), 1), 6) AS f1 FROM
(SELECT class, y, said, rank() OVER (PARTITION BY class ORDER BY s) + (count(*) OVER (PARTITION BY class, s) - 1) / 2::DOUBLE AS r FROM (SELECT class::INT AS class, CAST(label = class AS INT) AS y, CAST(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 = class AS INT) AS said, embedding[class + 1]::DOUBLE AS s FROM features, unnest(range(0, 10)) t(class))) GROUP BY 1)""")
def class_metrics(spark, d):
    return metrics.class_metrics(_ten(spark, d), "scores", "label")


@query("""SELECT round(e, 6) AS estimate, round(2 * e - hi, 6) AS low, round(2 * e - lo, 6) AS high FROM (SELECT avg(CAST(p = label AS INT)::DOUBLE) AS e FROM (SELECT label, CAST(image_id % 10 AS INT) AS p FROM features)), (SELECT quantile_cont(m, 0.975) AS hi, quantile_cont(m, 0.025) AS lo FROM (SELECT b, sum(v * w) / sum(w) AS m FROM
(SELECT b, v, (u >= 0.367879441171)::INT + (u >= 0.735758882343)::INT + (u >= 0.919698602929)::INT + (u >= 0.981011843124)::INT + (u >= 0.996340153173)::INT + (u >= 0.999405815182)::INT AS w FROM
(SELECT b, CAST(label = image_id % 10 AS INT)::DOUBLE AS v, ('0x' || sha256(concat_ws('|', b::VARCHAR, image_id::VARCHAR))[1:8])::BIGINT / 4294967296::DOUBLE AS u FROM features, unnest(range(0, 200)) t(b))) GROUP BY b))""")
def bootstrap_accuracy(spark, d):
    rows = features(spark, d).select("image_id", "label", (F.col("image_id") % 10).cast("int").alias("p"))
    return metrics.bootstrap_interval(rows, "image_id", "p", 200, statistic="accuracy", label="label")


def filled_masks(spark, d):
    """Pixels of each slide's first class with holes filled; iterative, so without SQL."""
    crowd = mask(spark, d).withColumn("slide_id", F.floor(F.col("slide_id") / 4000))
    return rasters.binary_mask(crowd, 1)


QUERIES["filled_masks"] = filled_masks
