"""The registered queries of slide analytics over the bound tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotations as an
from ..operators import cohorts, metrics, pixels, pooling, tiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TILE = 512


def query(sql: str | None = None):
    """Registers a function by its name, with its SQL."""
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {_VIEWS} {sql}"
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slides(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("slide_id"), (F.col("p_size") * 256).alias("width"), (F.col("p_size") * 128).alias("height"))


def vertices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("slide_id"), F.col("event_type").alias("label"), F.dayofmonth("ts").alias("roi_id"), F.col("event_id").alias("vertex_id"),
        F.floor(F.col("value") * 10).cast("int").alias("x"), (F.col("event_id") % 4096).cast("int").alias("y"),
    )


def mask(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("slide_id"), (F.col("l_partkey") % 64).cast("int").alias("row"), (F.col("l_suppkey") % 64).cast("int").alias("col"), F.col("l_linenumber").alias("class_id"))


def features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.floor(F.col("vec_id") / 25).alias("slide_id"), (F.col("vec_id") % 25).cast("int").alias("tile_no"), "embedding", "label", F.col("embedding")[0].cast("double").alias("e0"), F.col("embedding")[1].cast("double").alias("e1"))


_VIEWS = """slides AS (SELECT p_partkey AS slide_id, p_size * 256 AS width, p_size * 128 AS height FROM part),
vertices AS (SELECT user_id AS slide_id, event_type AS label, day(ts) AS roi_id, event_id AS vertex_id, CAST(floor(value * 10) AS INT) AS x, CAST(event_id % 4096 AS INT) AS y FROM events),
mask AS (SELECT l_orderkey AS slide_id, CAST(l_partkey % 64 AS INT) AS "row", CAST(l_suppkey % 64 AS INT) AS col, l_linenumber AS class_id FROM lineitem),
features AS (SELECT vec_id AS image_id, vec_id // 25 AS slide_id, vec_id % 25 AS tile_no, embedding, label, embedding[1]::DOUBLE AS e0, embedding[2]::DOUBLE AS e1 FROM embeddings),
pixels AS (SELECT vec_id AS image_id, label, list_transform(embedding, lambda v: greatest(0, least(255, CAST(floor((v::DOUBLE + 1) * 127.5::DOUBLE) AS INT)))) AS px FROM embeddings),
scored AS (SELECT image_id, e0 AS logit, CAST(label % 2 = 1 AS INT) AS label FROM features),
history AS (SELECT event_type AS config, user_id % 5 AS split, day(ts) AS epoch, round(avg(value), 6) AS value FROM events GROUP BY ALL),
clinical AS (SELECT c_custkey AS patient, c_nationkey AS center, abs(c_acctbal) AS time, c_acctbal > 0 AS event, round(c_custkey % 97 / 97.0::DOUBLE, 6) AS risk FROM customer)
"""


def image_pixels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), "label", pixels.to_pixels(F.col("embedding")).alias("px"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).select("image_id", F.col("e0").alias("logit"), (F.col("label") % 2 == 1).cast("int").alias("label"))


def history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("config"), (F.col("user_id") % 5).alias("split"), F.dayofmonth("ts").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("value"))


def clinical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("patient"), F.col("c_nationkey").alias("center"), F.abs("c_acctbal").alias("time"), (F.col("c_acctbal") > 0).alias("event"), F.round(F.col("c_custkey") % 97 / 97.0, 6).alias("risk"))


# -- tiles ---------------------------------------------------------------------


@query(f"SELECT slide_id, x::INT AS x, y::INT AS y FROM slides, unnest(range(0, height, {TILE})) a(x), unnest(range(0, width, {TILE})) b(y)")
def tile_grid(spark, d):
    return tiles.tile_grid(slides(spark, d), TILE)


@query(f"SELECT slide_id, x::INT AS x, y::INT AS y FROM slides, unnest(range(0, height, {TILE})) a(x), unnest(range(0, width, {TILE})) b(y) WHERE x + {TILE} <= height AND y + {TILE} <= width")
def tile_grid_drop_edges(spark, d):
    return tiles.tile_grid(slides(spark, d), TILE, drop_edges=True)


@query("SELECT slide_id, CAST(ceil(width / 1000.0) * 1000 AS BIGINT) AS width, CAST(ceil(height / 1000.0) * 1000 AS BIGINT) AS height FROM slides")
def snap_dimension(spark, d):
    s = slides(spark, d)
    return s.select("slide_id", *[tiles.snap_dimension(F.col(c), 1000).alias(c) for c in ("width", "height")])


@query("SELECT vertex_id, CAST(round_even(x / 4::DOUBLE, 0) AS BIGINT) AS x, CAST(round_even(y / 4::DOUBLE, 0) AS BIGINT) AS y FROM vertices")
def level_transform(spark, d):
    return vertices(spark, d).select("vertex_id", *[tiles.to_level(F.col(c), 4).alias(c) for c in "xy"])


@query("SELECT slide_id, 1024 AS x, 512 AS y, CAST(floor(greatest(least(4000, width - 1024), 0) / 4::DOUBLE) AS BIGINT) AS w, CAST(floor(greatest(least(3000, height - 512), 0) / 4::DOUBLE) AS BIGINT) AS h FROM slides")
def region_window(spark, d):
    return slides(spark, d).select("slide_id", F.inline(F.array(tiles.region_window(F.lit(1024), F.lit(512), F.lit(4000), F.lit(3000), F.col("width"), F.col("height"), 2))))


@query(f"SELECT slide_id, CAST(trunc(y / 3::DOUBLE) AS INT) AS \"left\", CAST(trunc(x / 3::DOUBLE) AS INT) AS top, {int(TILE / 3)} AS w, {int(TILE / 3)} AS h FROM slides, unnest(range(0, height, {TILE})) a(x), unnest(range(0, width, {TILE})) b(y)")
def overlay_rects(spark, d):
    return tiles.overlay_rects(tile_grid(spark, d), TILE, 3.0)


@query("""SELECT slide_id, x, y, pixels FROM (SELECT DISTINCT slide_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT DISTINCT slide_id FROM mask), unnest(range(0, 64, 16)) a(x), unnest(range(0, 64, 16)) b(y))
JOIN (SELECT slide_id, CAST("row" // 16 * 16 AS INT) AS x, CAST(col // 16 * 16 AS INT) AS y, count(*) AS pixels FROM mask WHERE class_id = 1 GROUP BY ALL) USING (slide_id, x, y) WHERE pixels >= 0.003 * 256""")
def tissue_filter(spark, d):
    m = mask(spark, d)
    grid = tiles.tile_grid(m.select("slide_id").distinct().select("slide_id", F.lit(64).alias("width"), F.lit(64).alias("height")), 16)
    return tiles.tissue_filter(grid, m, 16, 1, 0.003)


@query("SELECT image_id, slide_id, tile_no FROM features QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY sha256(concat_ws('|', image_id::VARCHAR, '7')), image_id) <= 5")
def sample_tiles(spark, d):
    return tiles.sample_per_group(features(spark, d).select("image_id", "slide_id", "tile_no"), "slide_id", ["image_id"], 5, seed=7)


@query("SELECT image_id, slide_id, tile_no FROM features WHERE tile_no < 10")
def first_n_tiles(spark, d):
    return tiles.first_per_group(features(spark, d).select("image_id", "slide_id", "tile_no"), "slide_id", "tile_no", 10)


@query("""SELECT slide_id, step::BIGINT AS step, n, round(n / ((floor((hx - lx) / step) + 1) * (floor((hy - ly) / step) + 1)), 6) AS completeness FROM
(SELECT slide_id, count(*) AS n, min(x) lx, max(x) hx, min(y) ly, max(y) hy FROM (SELECT DISTINCT slide_id, "row" AS x, col AS y FROM mask) GROUP BY 1)
JOIN (SELECT slide_id, min(gap)::DOUBLE AS step FROM (SELECT slide_id, x - lag(x) OVER (PARTITION BY slide_id ORDER BY x) AS gap FROM (SELECT DISTINCT slide_id, "row" AS x FROM mask) UNION ALL SELECT slide_id, y - lag(y) OVER (PARTITION BY slide_id ORDER BY y) FROM (SELECT DISTINCT slide_id, col AS y FROM mask)) GROUP BY 1 HAVING min(gap) IS NOT NULL) USING (slide_id)""")
def stitch_completeness(spark, d):
    return tiles.stitch_completeness(mask(spark, d).select("slide_id", F.col("row").alias("x"), F.col("col").alias("y")))


# -- annotations ---------------------------------------------------------------


@query("SELECT slide_id, CAST(trunc((min(x) - 100) / 2::DOUBLE) AS BIGINT) AS x_min, CAST(trunc((max(x) + 100) / 2::DOUBLE) AS BIGINT) AS x_max, CAST(trunc((min(y) - 100) / 2::DOUBLE) AS BIGINT) AS y_min, CAST(trunc((max(y) + 100) / 2::DOUBLE) AS BIGINT) AS y_max FROM vertices GROUP BY 1")
def annotation_bbox(spark, d):
    return an.bbox(vertices(spark, d), 100, 1)


@query("SELECT label, count(DISTINCT (slide_id, roi_id)) AS n_rois, count(*) AS n_vertices FROM vertices GROUP BY 1")
def roi_counts(spark, d):
    return an.roi_counts(vertices(spark, d))


@query("SELECT label, CAST(row_number() OVER (ORDER BY min(vertex_id), label) AS INT) AS class_id FROM vertices GROUP BY label")
def class_key(spark, d):
    return an.class_key(vertices(spark, d))


@query("SELECT CASE label WHEN 'click' THEN 'tumour' WHEN 'view' THEN 'stroma' ELSE label END AS label, count(*) AS n FROM vertices GROUP BY 1")
def rename_labels(spark, d):
    return an.rename_labels(vertices(spark, d), {"click": "tumour", "view": "stroma"}).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT vertex_id, label, x, y FROM vertices WHERE label IN ('click', 'view')")
def label_filter(spark, d):
    return an.filter_labels(vertices(spark, d), ["click", "view"]).select("vertex_id", "label", "x", "y")


@query("""SELECT slide_id, label, roi_id, count(*) AS n_vertices, round(abs(sum(x * ny - nx * y)) / 2, 3) AS area, round(sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)), 3) AS perimeter FROM (
SELECT slide_id, label, roi_id, x::DOUBLE AS x, y::DOUBLE AS y, coalesce(lead(x) OVER w, first_value(x) OVER w)::DOUBLE AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w)::DOUBLE AS ny FROM vertices WINDOW w AS (PARTITION BY slide_id, label, roi_id ORDER BY vertex_id)) GROUP BY ALL""")
def polygon_measures(spark, d):
    return an.polygon_measures(vertices(spark, d))


@query('SELECT slide_id, min("row") AS row_min, max("row") AS row_max, min(col) AS col_min, max(col) AS col_max, count(*) AS n_pixels FROM mask WHERE class_id <> 0 GROUP BY 1')
def mask_bbox(spark, d):
    return an.mask_bbox(mask(spark, d))


@query("SELECT class_id, count(*) AS n, round(sum(count(*)) OVER ()::DOUBLE / count(*), 6) AS weight FROM mask GROUP BY 1")
def class_weights(spark, d):
    return an.class_weights(mask(spark, d))


# -- cohorts -------------------------------------------------------------------


@query("SELECT doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d FULL OUTER JOIN labels l USING (doc_id)")
def outer_join_chain(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, d, "labels")
    return cohorts.merge_chain([docs, labels.select("doc_id", "quality"), labels.select("doc_id", "toxic")], ["doc_id", "doc_id"], ["full_outer", "full_outer"])


@query("SELECT doc_id, d.lang, l.quality FROM documents d RIGHT JOIN labels l USING (doc_id)")
def label_right_join(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "right")


@query("SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id) WHERE lang IN ('de', 'en', 'es', 'fr')")
def cohort_union_dropna(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return cohorts.union_cohorts([joined.where(F.col("lang") == x) for x in ("de", "en", "es", "fr")], ["quality"])


@query("SELECT DISTINCT lang, source FROM documents")
def dedup_labels(spark, d):
    return table(spark, d, "documents").select("lang", "source").dropDuplicates()


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, d):
    return cohorts.not_done(table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels"), "doc_id")


@query("SELECT lang, dense_rank() OVER (ORDER BY lang) - 1 AS code, doc_id FROM documents")
def label_encoder(spark, d):
    return cohorts.label_codes(table(spark, d, "documents").select("doc_id", "lang"), "lang")


@query("SELECT c_custkey AS patient, CASE WHEN c_acctbal > 0 THEN time ELSE -time END AS os, event FROM clinical JOIN customer ON patient = c_custkey")
def signed_survival(spark, d):
    return clinical(spark, d).select("patient", F.when(F.col("event"), F.col("time")).otherwise(-F.col("time")).alias("os"), "event")


@query("SELECT format('patch_patient_{:03d}_node_{}_x_{}_y_{}', o_custkey % 1000, o_orderkey % 5, o_orderkey // 5, o_custkey) AS image_id, substr(o_orderpriority, 1, 1) AS center FROM orders")
def id_parse(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.format_string("patch_patient_%03d_node_%d_x_%d_y_%d", F.col("o_custkey") % 1000, F.col("o_orderkey") % 5, F.floor(F.col("o_orderkey") / 5), F.col("o_custkey")).alias("image_id"), F.element_at(F.split("o_orderpriority", "-"), 1).alias("center"))


@query("SELECT image_id, CAST(label - CAST(label > 3 AS INT) AS INT) AS label FROM features WHERE label <> 3")
def remove_class_reindex(spark, d):
    return features(spark, d).where("label <> 3").select("image_id", (F.col("label") - (F.col("label") > 3).cast("int")).cast("int").alias("label"))


@query("SELECT doc_id, contains(source, '1') AS in_valid, contains(source, '2') OR contains(source, '3') AS in_test, NOT (contains(source, '1') OR contains(source, '2') OR contains(source, '3')) AS in_train FROM documents")
def split_by_name(spark, d):
    has = lambda names: F.exists(F.array(*map(F.lit, names)), lambda v: F.contains(F.col("source"), v))
    return table(spark, d, "documents").select("doc_id", has(["1"]).alias("in_valid"), has(["2", "3"]).alias("in_test"), (~has(["1", "2", "3"])).alias("in_train"))


@query("SELECT lr, wd, dropout FROM (VALUES (0.1::DOUBLE), (0.01)) a(lr), (VALUES (0.0::DOUBLE), (0.5)) b(wd), (VALUES (1), (2), (3)) c(dropout)")
def grid_search_cross(spark, d):
    one = spark.range(1)
    values = {"lr": [0.1, 0.01], "wd": [0.0, 0.5], "dropout": [1, 2, 3]}
    for name, options in values.items():
        one = one.withColumn(name, F.explode(F.array(*map(F.lit, options))))
    return one.drop("id")


@query("SELECT doc_id, CAST((row_number() OVER (PARTITION BY quality ORDER BY sha256(concat_ws('|', doc_id::VARCHAR, '3')), doc_id) - 1) % 5 AS INT) AS fold FROM labels")
def stratified_kfold(spark, d):
    return cohorts.kfold(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality", 5, seed=3).select("doc_id", "fold")


@query("""SELECT o_orderkey, fold FROM orders JOIN (SELECT o_custkey, CAST((row_number() OVER (PARTITION BY floor(log2(n)) ORDER BY sha256(concat_ws('|', o_custkey::VARCHAR, '3')), o_custkey) - 1) % 5 AS INT) AS fold
FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)) USING (o_custkey)""")
def stratified_group_kfold(spark, d):
    return cohorts.group_kfold(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 5, seed=3).select("o_orderkey", "fold")


@query("SELECT count(DISTINCT doc_id) AS n_slides, count(DISTINCT source) AS n_patients, count(DISTINCT lang) AS n_labels, count(*) AS n_rows FROM documents")
def dataset_stats(spark, d):
    return cohorts.dataset_stats(table(spark, d, "documents"), "doc_id", "source", "lang")


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def labels_distribution(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("SELECT CAST(ceil(sum(n_chars) / 100000::DOUBLE) AS BIGINT) AS n_shards, CAST(ceil(count(*) / ceil(sum(n_chars) / 100000::DOUBLE)) AS BIGINT) AS files_per_shard, count(*) AS n_files FROM documents")
def shard_plan(spark, d):
    return cohorts.shard_plan(table(spark, d, "documents"), "n_chars", 100_000)


# -- pixels --------------------------------------------------------------------


@query("SELECT image_id, round(list_sum(px)::DOUBLE / len(px), 6) AS mean FROM pixels WHERE list_sum(px)::DOUBLE / len(px) <= 128")
def intensity_filter(spark, d):
    p = image_pixels(spark, d).withColumn("mean", pixels.mean_intensity(F.col("px")))
    return p.where("mean <= 128").select("image_id", F.round("mean", 6).alias("mean"))


@query("SELECT image_id, round(len(list_filter(px, lambda v: v <= 115))::DOUBLE / len(px), 6) AS dark FROM pixels")
def black_area(spark, d):
    return image_pixels(spark, d).select("image_id", F.round(pixels.dark_share(F.col("px"), 115), 6).alias("dark"))


@query("""SELECT image_id, round(sum(CASE WHEN hi > lo AND 255.0::DOUBLE * (hi - lo) / hi >= 150 AND (CASE WHEN hi = b THEN 120 + 30.0::DOUBLE * (r - g) / (hi - lo) WHEN hi = g THEN 60 + 30.0::DOUBLE * (b - r) / (hi - lo) ELSE 30.0::DOUBLE * (g - b) / (hi - lo) END) BETWEEN 100 AND 130 THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS blue
FROM (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM (SELECT image_id, (px[i] * 7) % 256 AS r, (px[i] * 3) % 256 AS g, (px[i] * 31) % 256 AS b FROM pixels, unnest(range(1, 65)) t(i))) GROUP BY 1""")
def blue_area(spark, d):
    rgb = F.transform("px", lambda v: F.struct((v * 7 % 256).alias("r"), (v * 3 % 256).alias("g"), (v * 31 % 256).alias("b")))
    return image_pixels(spark, d).select("image_id", F.round(pixels.blue_share(rgb), 6).alias("blue"))


@query("""SELECT arg_min(bin, (-between_var, bin))::INT AS threshold FROM (SELECT bin, round(w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) / w / w, 6) AS between_var FROM
(SELECT bin, (sum(n) OVER o)::DOUBLE w0, (sum(n * bin) OVER o)::DOUBLE s0, (sum(n) OVER ())::DOUBLE w, (sum(n * bin) OVER ())::DOUBLE s FROM (SELECT unnest(px) AS bin, count(*) AS n FROM pixels GROUP BY 1) WINDOW o AS (ORDER BY bin)) WHERE w > w0)""")
def otsu_threshold(spark, d):
    return pixels.otsu_threshold(image_pixels(spark, d).select(F.explode("px").alias("bin")).groupBy("bin").agg(F.count("*").alias("n")))


@query("SELECT channel, round(avg(v / 255::DOUBLE), 6) AS mean, round(stddev_pop(v / 255::DOUBLE), 6) AS std, count(*) AS n FROM (SELECT i % 3 AS channel, px[i + 1] AS v FROM pixels, unnest(range(0, 64)) t(i)) GROUP BY 1")
def channel_stats(spark, d):
    p = image_pixels(spark, d).select(F.posexplode("px").alias("i", "v")).select((F.col("i") % 3).alias("channel"), "v")
    return pixels.channel_stats(p, "channel", "v")


@query("SELECT image_id, round(list_sum(list_transform(px, lambda v: (v / 255::DOUBLE - 0.5::DOUBLE) / 0.5::DOUBLE)), 5) AS total FROM pixels")
def pixel_normalize(spark, d):
    p = image_pixels(spark, d).withColumn("z", pixels.normalize(F.col("px"), 0.5, 0.5))
    return p.select("image_id", F.round(F.aggregate("z", F.lit(0.0), lambda a, b: a + b), 5).alias("total"))


@query("SELECT image_id, CAST(pos AS INT) AS pos, round((v - m) / s, 5) AS z FROM (SELECT image_id, i AS pos, embedding[i + 1]::DOUBLE AS v, avg(embedding[i + 1]::DOUBLE) OVER (PARTITION BY i) AS m, stddev_pop(embedding[i + 1]::DOUBLE) OVER (PARTITION BY i) AS s FROM features, unnest(range(0, 64)) t(i))")
def standard_scale(spark, d):
    return pixels.standard_scale(features(spark, d), "image_id", "embedding")


# -- pooling -------------------------------------------------------------------


@query("SELECT slide_id, CAST(i AS INT) AS pos, round(avg(embedding[i + 1]::DOUBLE), 6) AS mean FROM features, unnest(range(0, 64)) t(i) GROUP BY ALL")
def mean_pool(spark, d):
    return pooling.mean_pool(features(spark, d))


@query("SELECT image_id, round(exp(e0 - max(e0) OVER w) / sum(exp(e0)) OVER w * exp(max(e0) OVER w), 6) AS p FROM features WINDOW w AS (PARTITION BY slide_id)")
def softmax(spark, d):
    return pooling.softmax(features(spark, d), "slide_id", "e0", "p").select("image_id", F.round("p", 6).alias("p"))


@query("SELECT slide_id, round(sum(exp(e0) * e1) / sum(exp(e0)), 6) AS pooled, count(*) AS n_tiles FROM features GROUP BY 1")
def gated_attention_pool(spark, d):
    return pooling.attention_pool(features(spark, d), "slide_id", "e0", "e1")


@query(""", k AS (SELECT DISTINCT slide_id, p FROM features, unnest(range(1, 31)) t(p)), t AS (SELECT slide_id, e0, row_number() OVER (PARTITION BY slide_id ORDER BY e0 DESC) AS hi, row_number() OVER (PARTITION BY slide_id ORDER BY e0) AS lo FROM features)
SELECT slide_id, 'top' AS side, p::INT AS place, round(coalesce(e0, 0), 6) AS score FROM k LEFT JOIN t USING (slide_id) WHERE false UNION ALL
SELECT k.slide_id, 'top', p::INT, round(coalesce(e0, 0), 6) FROM k LEFT JOIN t ON t.slide_id = k.slide_id AND hi = p UNION ALL SELECT k.slide_id, 'bottom', p::INT, round(coalesce(e0, 0), 6) FROM k LEFT JOIN t ON t.slide_id = k.slide_id AND lo = p WHERE p <= 3""")
def extreme_scores(spark, d):
    return pooling.extreme_scores(features(spark, d), "slide_id", "e0", 30, 3).withColumn("score", F.round("score", 6))


@query("SELECT image_id, round((rank() OVER (PARTITION BY slide_id ORDER BY e0) + (count(*) OVER (PARTITION BY slide_id, e0) - 1) / 2::DOUBLE) * 100 / count(*) OVER (PARTITION BY slide_id), 6) AS percentile FROM features")
def attention_rank(spark, d):
    return pooling.percentile_rank(features(spark, d), "slide_id", "e0").select("image_id", "percentile")


@query("""SELECT slide_id, c.image_id AS critical, round(max(list_sum(list_transform(range(1, 65), lambda i: f.embedding[i]::DOUBLE * c.embedding[i]::DOUBLE))), 5) AS attention_max
FROM features f JOIN (SELECT slide_id, image_id, embedding FROM features QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY e0 DESC, image_id) = 1) c USING (slide_id) GROUP BY ALL""")
def critical_instance_pool(spark, d):
    return pooling.critical_instance_pool(features(spark, d), "slide_id", "image_id", "e0", "embedding")


@query("""SELECT slide_id, r, c, round(sum(score) / count(*), 6) AS heat, count(*) AS n FROM (SELECT slide_id, "row" // 8 + dx AS r, col // 8 + dy AS c, class_id::DOUBLE AS score FROM mask, unnest([0, 1]) a(dx), unnest([0, 1]) b(dy)) GROUP BY ALL""")
def heatmap_blend(spark, d):
    at = lambda c: F.floor(F.col(c) / 8)
    cells = mask(spark, d).groupBy("slide_id", at("row").alias("r0"), at("col").alias("c0")).agg(F.sum(F.col("class_id").cast("double")).alias("s"), F.count("*").alias("m"))
    steps = F.array(F.lit(0), F.lit(1))
    shifted = cells.select("slide_id", "s", "m", "c0", F.explode(F.transform(steps, lambda k: F.col("r0") + k)).alias("r")).select("slide_id", "s", "m", "r", F.explode(F.transform(steps, lambda k: F.col("c0") + k)).alias("c"))
    return shifted.groupBy("slide_id", "r", "c").agg(F.round(F.sum("s") / F.sum("m"), 6).alias("heat"), F.sum("m").alias("n"))


# -- metrics -------------------------------------------------------------------


@query("SELECT round(avg(CASE WHEN CAST(logit > 0 AS INT) = label THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, count(*) AS n FROM scored")
def accuracy(spark, d):
    return metrics.accuracy(scored(spark, d))


@query("SELECT round((sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2::DOUBLE) / (sum(label) * sum(1 - label)), 6) AS auc FROM (SELECT label, rank() OVER (ORDER BY logit) + (count(*) OVER (PARTITION BY logit) - 1) / 2::DOUBLE AS r FROM scored)")
def binary_auc(spark, d):
    return metrics.binary_auc(scored(spark, d), "logit")


@query("""SELECT class, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2::DOUBLE) / (sum(y) * sum(1 - y)), 6) AS auc FROM
(SELECT class, y, rank() OVER (PARTITION BY class ORDER BY s) + (count(*) OVER (PARTITION BY class, s) - 1) / 2::DOUBLE AS r FROM (SELECT class::INT AS class, CAST(label = class AS INT) AS y, embedding[class + 1]::DOUBLE AS s FROM features, unnest(range(0, 10)) t(class))) GROUP BY 1""")
def macro_ovr_auc(spark, d):
    f = features(spark, d).select("label", F.posexplode(F.slice("embedding", 1, 10)).alias("class", "s")).select("class", F.col("s").cast("double").alias("s"), (F.col("label") == F.col("class")).cast("int").alias("y"))
    return metrics.binary_auc(f, "s", "y", "class")


@query("SELECT round(sum(CASE WHEN a.risk > b.risk THEN 1.0::DOUBLE WHEN a.risk = b.risk THEN 0.5 ELSE 0 END) / count(*), 6) AS cindex, count(*) AS n_pairs FROM clinical a JOIN clinical b ON a.event AND (a.time < b.time OR (a.time = b.time AND NOT b.event))")
def cindex(spark, d):
    return metrics.cindex(clinical(spark, d), "time", "event", "risk")


@query("SELECT class, count_if(p = class AND label = class) AS tp, count_if(p = class AND label <> class) AS fp, count_if(p <> class AND label = class) AS fn, round(2 * count_if(p = class AND label = class)::DOUBLE / (2 * count_if(p = class AND label = class) + count_if(p = class AND label <> class) + count_if(p <> class AND label = class)), 6) AS f1 FROM (SELECT label, CAST(image_id % 10 AS INT) AS p, unnest(list_distinct([label, CAST(image_id % 10 AS INT)])) AS class FROM features) GROUP BY class")
def per_class_f1(spark, d):
    return metrics.class_scores(features(spark, d).select("label", (F.col("image_id") % 10).cast("int").alias("prediction")))


@query("""SELECT round(e, 6) AS estimate, round(2 * e - hi, 6) AS low, round(2 * e - lo, 6) AS high FROM (SELECT avg(label::DOUBLE) AS e FROM features), (SELECT quantile_cont(m, 0.975) AS hi, quantile_cont(m, 0.025) AS lo FROM (SELECT b, sum(v * w) / sum(w) AS m FROM
(SELECT b, v, (u >= 0.367879441171)::INT + (u >= 0.735758882343)::INT + (u >= 0.919698602929)::INT + (u >= 0.981011843124)::INT + (u >= 0.996340153173)::INT + (u >= 0.999405815182)::INT AS w FROM
(SELECT b, label::DOUBLE AS v, ('0x' || sha256(concat_ws('|', b::VARCHAR, image_id::VARCHAR))[1:8])::BIGINT / 4294967296::DOUBLE AS u FROM features, unnest(range(0, 1000)) t(b))) GROUP BY b))""")
def bootstrap_ci(spark, d):
    return metrics.bootstrap_interval(features(spark, d).select("image_id", "label"), "image_id", "label")


@query("SELECT round(avg(greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))), 6) AS loss FROM scored")
def bce_loss(spark, d):
    return scored(spark, d).agg(F.round(F.avg(metrics.bce_loss(F.col("logit"), F.col("label"))), 6).alias("loss"))


@query("SELECT center, round(avg(CASE WHEN event THEN ln(h) - risk ELSE 0 END), 6) AS loss, count(*) AS n FROM (SELECT center, event, risk, sum(exp(risk)) OVER (PARTITION BY center ORDER BY time DESC, event DESC, patient ROWS UNBOUNDED PRECEDING) AS h FROM clinical) GROUP BY 1")
def cox_loss(spark, d):
    return metrics.cox_loss(clinical(spark, d), "center", "time", "event", "risk", "patient")


@query("SELECT config, epoch, round(v, 6) AS value FROM (SELECT config, epoch, round(avg(value), 9) AS v FROM history GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY config ORDER BY v DESC, epoch) = 1")
def epoch_select(spark, d):
    return metrics.select_epoch(history(spark, d))


@query("SELECT config, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (SELECT config, split, arg_max(value, epoch) AS v FROM history GROUP BY ALL) GROUP BY 1")
def cv_summary(spark, d):
    return metrics.cv_summary(history(spark, d))


@query("SELECT config, round(avg(value) FILTER (split = 0), 6) AS s0, round(avg(value) FILTER (split = 1), 6) AS s1, round(avg(value) FILTER (split = 2), 6) AS s2, round(avg(value) FILTER (split = 3), 6) AS s3, round(avg(value) FILTER (split = 4), 6) AS s4 FROM history GROUP BY 1")
def results_pivot(spark, d):
    wide = history(spark, d).groupBy("config").pivot("split", [0, 1, 2, 3, 4]).agg(F.round(F.avg("value"), 6))
    return wide.select("config", *[F.col(str(i)).alias(f"s{i}") for i in range(5)])


@query(f"""SELECT slide_id, n_tiles, mean_e0 FROM (SELECT slide_id, count(*) AS n_tiles FROM slides, unnest(range(0, height, {TILE})) a(x), unnest(range(0, width, {TILE})) b(y) WHERE x + {TILE} <= height AND y + {TILE} <= width GROUP BY 1)
LEFT JOIN (SELECT slide_id, round(avg(e0), 6) AS mean_e0 FROM features GROUP BY 1) USING (slide_id)""")
def slide_summary(spark, d):
    """Of each slide: the tiles within its border, and its tiles' mean first feature."""
    n = tiles.tile_count(F.col("height"), TILE, drop_edges=True) * tiles.tile_count(F.col("width"), TILE, drop_edges=True)
    counts = slides(spark, d).groupBy("slide_id").agg(F.sum(n).alias("n_tiles")).where("n_tiles > 0")
    means = features(spark, d).groupBy("slide_id").agg(F.round(F.avg("e0"), 6).alias("mean_e0"))
    return counts.join(means, "slide_id", "left")
