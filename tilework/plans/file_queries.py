"""Registered queries over files that are written and read back, and over given networks. Importing this adds them to QUERIES and SQL."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import attention, tissue
from ..operators.tables import checkpoint_dir
from ..sources import arrays, records, tiled_images
from .cohort_queries import QUERIES, SQL
from .queries import features, image_pixels, query, table

__all__ = ["QUERIES", "SQL"]


def _folder(spark, name: str) -> str:
    """A new folder in the one that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT slide_id::VARCHAR AS slide_id, tile_no::BIGINT AS \"row\", CAST(len(embedding) AS INT) AS n, round(e0, 6) AS e0 FROM features WHERE tile_no < 10")
def array_rows(spark, d):
    """Feature files of all slides, of which the first ten rows are read back."""
    folder = _folder(spark, "arrays")
    arrays.write_arrays(features(spark, d), folder, "slide_id", "tile_no", "embedding").count()
    rows = arrays.read_arrays(spark, folder, rows=10)
    return rows.select("slide_id", "row", F.size("values").alias("n"), F.round(F.get("values", F.lit(0)), 6).alias("e0"))


@query("SELECT doc_id, source AS split, octet_length(encode(coalesce(text, ''))) AS n_bytes, sha256(coalesce(text, '')) AS sha, n_chars::BIGINT AS n_chars FROM documents")
def record_shards(spark, d):
    """All documents as record shards by source, and read back."""
    folder = _folder(spark, "records")
    docs = table(spark, d, "documents")
    records.write_records(docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.col("source").alias("split"), F.col("source").alias("name"), F.col("n_chars").cast("long").alias("n_chars")), folder, 4, "split")
    back = records.read_records(spark, folder, "doc_id long, text binary, name string, n_chars long")
    return back.select("doc_id", F.col("name").alias("split"), F.length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"), "n_chars")


@query("""SELECT slide_id::VARCHAR AS slide_id, CAST(x // 16 AS INT) AS block_row, CAST(y // 16 AS INT) AS block_col, CAST(sum(v) AS BIGINT) AS total FROM
(SELECT image_id // 25 AS slide_id, image_id % 25 // 5 * 8 + i // 8 AS x, image_id % 5 * 8 + i % 8 AS y, px[i + 1] AS v FROM pixels, unnest(range(64)) t(i)) GROUP BY ALL
UNION ALL SELECT slide_id::VARCHAR, r::INT, c::INT, 0 FROM (SELECT DISTINCT image_id // 25 AS slide_id FROM pixels) s, unnest(range(3)) a(r), unnest(range(3)) b(c) WHERE NOT EXISTS (SELECT 1 FROM pixels p, unnest(range(64)) t(i)
WHERE p.image_id // 25 = s.slide_id AND (p.image_id % 25 // 5 * 8 + i // 8) // 16 = r AND (p.image_id % 5 * 8 + i % 8) // 16 = c)""")
def slide_pyramids(spark, d):
    """Slides of 5 x 5 tiles written as tiled pyramids and read back by tile: the sum of each block's pixels at level 0."""
    folder = _folder(spark, "slides")
    tiles = image_pixels(spark, d).groupBy(F.floor(F.col("image_id") / 25).cast("string").alias("slide_id")).agg(F.collect_list(F.struct((F.col("image_id") % 25).cast("int").alias("no"), "px")).alias("tiles"))

    def write(batches):
        for batch in batches:
            for row in batch.to_pylist():
                files, root = tiled_images.files_of(folder)
                image = np.zeros((40, 40, 1), "u1")
                for t in row["tiles"]:
                    r, c = divmod(t["no"], 5)
                    image[8 * r : 8 * r + 8, 8 * c : 8 * c + 8, 0] = np.array(t["px"], "u1").reshape(8, 8)
                files.create_dir(root, recursive=True)
                with files.open_output_stream(f"{root}/{row['slide_id']}.tif") as out:
                    out.write(tiled_images.encode_pyramid([image, image[::2, ::2]], 16))
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["slide_id"])

    tiles.mapInArrow(write, "slide_id string").count()

    def summed(batches):
        for batch in batches:
            sums = [int(np.frombuffer(x.as_buffer(), "u1").sum()) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], ["slide_id", "block_row", "block_col", "total"])

    found = tiled_images.read_slides(spark, folder, levels="0").select("slide_id", "block_row", "block_col", "data")
    return found.mapInArrow(summed, "slide_id string, block_row int, block_col int, total long")


@query("""SELECT slide_id, tile_no, round(exp(s) / sum(exp(s)) OVER (PARTITION BY slide_id), 6) AS attention FROM (SELECT f.slide_id, f.tile_no, list_sum(list_transform(range(1, 65), lambda i: f.embedding[i]::DOUBLE * c.embedding[i]::DOUBLE)) / 8 AS s
FROM features f JOIN (SELECT slide_id, embedding FROM features WHERE tile_no = 0) c USING (slide_id)) QUALIFY tile_no > 0""")
def class_attention(spark, d):
    """How much each slide's first tile attends to its others, by one head without projections."""
    one = np.eye(64)
    found = attention.class_attention(features(spark, d), "slide_id", "tile_no", "embedding", one, one)
    return found.select("slide_id", "tile_no", F.round("attention", 6).alias("attention"))


@query(""", f AS (SELECT slide_id, tile_no // 4 AS region, tile_no % 4 AS place, k, sum(embedding[i + 1]::DOUBLE * cos(i * k * pi() / 8)) AS v FROM features, unnest(range(64)) t(i), unnest(range(8)) u(k) GROUP BY ALL)
SELECT slide_id, region, CAST(pos AS INT) AS pos, round(v, 4) AS v FROM (SELECT slide_id, region, k AS pos, avg(v) AS v FROM f GROUP BY ALL UNION ALL SELECT slide_id, region, 8 + j, sum(v * cos((place * 8 + k) * j * pi() / 8)) FROM f, unnest(range(8)) w(j) GROUP BY ALL)""")
def two_level_embedding(spark, d):
    """Regions of four tiles through two encoders: the mean of the first's vectors, and the second's of all of them."""
    f = features(spark, d).select("slide_id", F.floor(F.col("tile_no") / 4).alias("region"), (F.col("tile_no") % 4).alias("place"), "embedding")
    made = attention.two_level(f, "slide_id", "region", "place", "embedding", "cosine8", "cosine8", 4, 8)
    return made.select("slide_id", "region", F.posexplode("features").alias("pos", "v")).withColumn("v", F.round("v", 4))


#: Layers of a small scorer, by a rule that SQL can follow.
_HIDDEN = np.cos(np.outer(np.arange(1, 5), np.arange(64)) * math.pi / 64), np.arange(4) / 10
_LAST = np.array([[1.0, 2.0, 3.0, 4.0], [-1.0, -2.0, -3.0, -4.0]]), None


@query("""SELECT image_id, CAST(c AS INT) AS class, CASE WHEN tile_no % 5 = 4 THEN -1 ELSE round((1 - 2 * c) * s, 5) + 0::DOUBLE END AS score FROM (SELECT image_id, tile_no, sum((o + 1) * greatest(h + o / 10::DOUBLE, 0)) AS s FROM
(SELECT image_id, tile_no, o, sum(embedding[i + 1]::DOUBLE * cos((o + 1) * i * pi() / 64)) AS h FROM features, unnest(range(64)) t(i), unnest(range(4)) u(o) GROUP BY ALL) GROUP BY ALL), unnest(range(2)) v(c)""")
def masked_scores(spark, d):
    """A hidden layer and two scores of each tile; every fifth is padding."""
    f = features(spark, d).withColumn("padding", F.col("tile_no") % 5 == 4)
    found = attention.score_layers(f, ["image_id"], "embedding", [_HIDDEN, _LAST], mask="padding", masked_value=-1.0)
    return found.select("image_id", F.posexplode("scores").alias("class", "score")).withColumn("score", F.round("score", 5))


def nystroem_pool(spark, d):
    """Each slide's mean after attention by eight landmarks."""
    made = attention.nystroem_attention(features(spark, d), "slide_id", "tile_no", "embedding", 8)
    return made.select("slide_id", F.posexplode("attended").alias("pos", "v")).groupBy("slide_id", "pos").agg(F.round(F.avg("v"), 5).alias("v"))


def tissue_contours(spark, d):
    """Runs of tissue in all images, coloured by a rule; disks of 5 pixels on images of 8 x 8."""
    rgb = F.flatten(F.transform("px", lambda v: F.array(v * 7 % 256, v * 3 % 256, v * 31 % 256)))
    images = image_pixels(spark, d).select(F.col("image_id").alias("slide_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(3).alias("channels"), F.unhex(F.array_join(F.transform(rgb, lambda v: F.lpad(F.hex(v), 2, "0")), "")).alias("data"))
    return tissue.tissue_runs(images, ((5, 5000.0, 5000.0), (5, 50.0, 3.0)))


QUERIES |= {f.__name__: f for f in (nystroem_pool, tissue_contours)}
